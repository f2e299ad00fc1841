"""Bindings of the trace statistics to pipeline_record, at the fixed clock of the test data."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import stats
from quillspark.operators.delivery import instant
from quillspark.sources import jsonl
from quillspark.sources.tables import table

NOW = datetime(2024, 1, 31)
DAYS = 7


def _trace(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pipeline_record")


def _window(spark: SparkSession, sf: str) -> DataFrame:
    return stats.in_window(_trace(spark, sf), NOW, DAYS)


def stats_window_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _window(spark, sf).select("record_seq", "drop_id", "duration_ms")


def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.summary(_window(spark, sf), "duration_ms")


def latency_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    return stats.summary(_window(spark, sf).where("target_kind is not null"), "duration_ms", "target_kind")


def nearest_rank_quantile(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles per slug, so that many small groups are covered."""
    rows = _trace(spark, sf).where("duration_ms >= 0 and slug is not null")
    return stats.quantiles(rows, "duration_ms", "slug").select("slug", "n", *stats.QUANTILES)


def stage_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return stats.by_stage(_window(spark, sf))


def error_rate(spark: SparkSession, sf: str) -> DataFrame:
    return stats.rates(_window(spark, sf))


def kind_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return stats.kind_counts(_window(spark, sf))


def pipeline_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.report(_window(spark, sf))


def stage_time_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Time per drop and stage over all its runs."""
    s = stats.stage_values(_trace(spark, sf).where("drop_id is not null"), "drop_id").where("ms >= 0")
    return s.groupBy("drop_id", "stage").agg(F.sum("ms").alias("ms"), F.count("*").alias("runs"))


def daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling one-day windows of the run time."""
    t = _trace(spark, sf).withColumn("at", instant(F.col("ts"))).where("at is not null")
    w = t.groupBy(F.window("at", "1 day").alias("w")).agg(F.count("*").alias("runs"), F.count_if(F.length("blocked_reason") > 0).alias("blocked"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "runs", "blocked")


def jsonl_tolerant_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written as JSON lines with every seventh line cut short, read back."""
    t = _trace(spark, sf)
    line = F.to_json(F.struct("ts", "drop_id", "duration_ms", "target_kind"))
    torn = F.when(F.col("record_seq") % 7 == 0, F.substr(line, F.lit(1), F.length(line) - 5)).otherwise(line)
    back = t.select("record_seq", jsonl.parse(torn).alias("r")).where("r.ts is not null")
    return back.select("record_seq", "r.ts", "r.drop_id", "r.duration_ms", "r.target_kind")


def tail_n(spark: SparkSession, sf: str) -> DataFrame:
    """The last three runs of every kind."""
    w = Window.partitionBy("target_kind").orderBy(F.desc("record_seq"))
    return _trace(spark, sf).where("target_kind is not null").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("target_kind", "record_seq", "slug", "rn")


def tail_n_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Few-shot examples: not expired, of a known kind, slug made canonical, last ten."""
    h = table(spark, sf, "harvested_fixture")
    at = instant(F.col("harvested_at"))
    e = h.where(at + F.expr("interval 30 days") > F.lit(NOW.isoformat(" ")).cast("timestamp")).where(F.col("expected.target_kind").isin(*text.KINDS))
    return e.orderBy(F.desc("fixture_no")).limit(10).select("fixture_no", F.substring("input.text", 1, 200).alias("excerpt"), F.col("expected.target_kind").alias("target_kind"), text.slugify(F.col("expected.slug")).alias("slug"))


def last_n_drops(spark: SparkSession, sf: str) -> DataFrame:
    """Newest runs first, over the last 14 days of received rows."""
    t = _trace(spark, sf).where(F.col("received_at") >= F.lit("2024-01-17").cast("timestamp"))
    return t.orderBy(F.desc(F.to_date("received_at")), F.desc("record_seq")).limit(20).select("record_seq", "slug", "target_kind", F.date_format("received_at", "yyyy-MM-dd").alias("day"))


_T = "SELECT *, try_cast(trim(ts) AS TIMESTAMPTZ) AS run_at FROM pipeline_record"
_W = f"WITH w AS (SELECT * FROM ({_T}) WHERE run_at >= TIMESTAMPTZ '2024-01-24 00:00:00+00')"
_SUM = """count(*) AS n, CAST(coalesce(quantile_disc(v, 0.5), 0) AS BIGINT) AS p50, CAST(coalesce(quantile_disc(v, 0.95), 0) AS BIGINT) AS p95,
 CAST(coalesce(quantile_disc(v, 0.99), 0) AS BIGINT) AS p99, CAST(trunc(coalesce(avg(v), 0)) AS BIGINT) AS mean,
 CAST(coalesce(min(v), 0) AS BIGINT) AS min, CAST(coalesce(max(v), 0) AS BIGINT) AS max"""
_PLACE = "list_position(['orchestrator', 'classifier', 'extractor', 'verifier', 'writer'], stage)"
_STAGES = f"""s AS (SELECT e.key AS stage, e.value AS ms FROM (SELECT unnest(map_entries(stage_latency_ms)) AS e FROM w)),
st AS (SELECT stage, CAST({_PLACE} AS BIGINT) AS place, {_SUM} FROM (SELECT *, CAST(trunc(ms) AS BIGINT) AS v FROM s WHERE ms >= 0) WHERE {_PLACE} > 0 GROUP BY stage)"""
_RATES = """r AS (SELECT count(*) FILTER (WHERE duration_ms >= 0) AS n, count(*) FILTER (WHERE length(blocked_reason) > 0) AS blocked,
 count(*) FILTER (WHERE escalated) AS escalated FROM w)"""

QUERIES = {
    f.__name__: f
    for f in (
        pipeline_stats, stats_window_filter, latency_summary, latency_by_kind, nearest_rank_quantile, stage_breakdown, error_rate,
        kind_histogram, stage_time_sum, daily_counts, jsonl_tolerant_scan, tail_n, tail_n_examples, last_n_drops,
    )
}
SQL = {
    "stats_window_filter": f"{_W} SELECT record_seq, drop_id, duration_ms FROM w",
    "latency_summary": f"{_W} SELECT {_SUM}, count(*) < 10 AS warming_up FROM (SELECT CAST(trunc(duration_ms) AS BIGINT) AS v FROM w WHERE duration_ms >= 0)",
    "latency_by_kind": f"{_W} SELECT target_kind, {_SUM} FROM (SELECT target_kind, CAST(trunc(duration_ms) AS BIGINT) AS v FROM w WHERE duration_ms >= 0 AND target_kind IS NOT NULL) GROUP BY target_kind",
    "nearest_rank_quantile": """SELECT slug, count(*) AS n, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95,
 quantile_disc(duration_ms, 0.99) AS p99 FROM pipeline_record WHERE duration_ms >= 0 AND slug IS NOT NULL GROUP BY slug""",
    "stage_breakdown": f"{_W}, {_STAGES} SELECT * FROM st",
    "error_rate": f"{_W}, {_RATES} SELECT n, blocked, escalated, blocked / nullif(n, 0) AS error_rate, escalated / nullif(n, 0) AS escalation_rate FROM r",
    "kind_histogram": f"{_W} SELECT target_kind, count(*) AS n FROM w WHERE target_kind IS NOT NULL GROUP BY target_kind",
    "pipeline_stats": f"""{_W}, {_STAGES}, {_RATES},
l AS (SELECT {_SUM} FROM (SELECT CAST(trunc(duration_ms) AS BIGINT) AS v FROM w WHERE duration_ms >= 0))
SELECT 'latency' AS section, 'all' AS name, n, p50, p95, p99, mean, 0.0::DOUBLE AS share FROM l
UNION ALL SELECT 'stage', stage, n, p50, p95, p99, mean, 0 FROM st
UNION ALL SELECT 'rate', 'error', n, 0, 0, 0, 0, coalesce(blocked / nullif(n, 0), 0) FROM r
UNION ALL SELECT 'rate', 'escalation', n, 0, 0, 0, 0, coalesce(escalated / nullif(n, 0), 0) FROM r
UNION ALL SELECT 'kind', target_kind, count(*), 0, 0, 0, 0, 0 FROM w WHERE target_kind IS NOT NULL GROUP BY target_kind""",
    "stage_time_sum": """SELECT drop_id, e.key AS stage, sum(e.value) AS ms, count(*) AS runs FROM (SELECT drop_id, unnest(map_entries(stage_latency_ms)) AS e
 FROM pipeline_record WHERE drop_id IS NOT NULL) WHERE e.value >= 0 GROUP BY drop_id, e.key""",
    "daily_counts": f"""SELECT strftime(run_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS runs, count(*) FILTER (WHERE length(blocked_reason) > 0) AS blocked
 FROM ({_T}) WHERE run_at IS NOT NULL GROUP BY 1""",
    "jsonl_tolerant_scan": "SELECT record_seq, ts, drop_id, duration_ms, target_kind FROM pipeline_record WHERE record_seq % 7 <> 0 AND ts IS NOT NULL",
    "tail_n": """SELECT target_kind, record_seq, slug, rn FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target_kind ORDER BY record_seq DESC) AS INT) AS rn
 FROM pipeline_record WHERE target_kind IS NOT NULL) WHERE rn <= 3""",
    "tail_n_examples": f"""SELECT fixture_no, substr(input.text, 1, 200) AS excerpt, expected.target_kind AS target_kind,
 substr(coalesce(nullif(trim(regexp_replace(lower(expected.slug), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'untitled'), 1, 50) AS slug FROM harvested_fixture
 WHERE try_cast(trim(harvested_at) AS TIMESTAMPTZ) + INTERVAL 30 DAY > TIMESTAMPTZ '2024-01-31 00:00:00+00' AND expected.target_kind IN {text.KINDS}
 ORDER BY fixture_no DESC LIMIT 10""",
    "last_n_drops": """SELECT record_seq, slug, target_kind, strftime(received_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM pipeline_record
 WHERE received_at >= TIMESTAMPTZ '2024-01-17 00:00:00+00' ORDER BY 4 DESC, record_seq DESC LIMIT 20""",
}
