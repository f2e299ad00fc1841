"""Bindings of the training-data operators to the test tables, with SQL where it can say the same."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import canonical, cooccur, history, leakage, lookalike, packing, pii, quantiles
from quillspark.session import materialise

#: A duration beyond one day is absurd, as is a negative one.
LONGEST_MS = 86_400_000


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- 1: tags that occur together -------------------------------------------------

MIN_TOGETHER, MIN_SHARE, MIN_LIFT = 5, 0.002, 3


def tag_sets(spark: SparkSession, sf: str) -> DataFrame:
    """(items, w): the baskets of the three tables, identical ones together."""
    c = cooccur.union_repeats(cooccur.baskets(_t(spark, sf, "classification"), "classification_id", "tags"))
    e = cooccur.baskets(_t(spark, sf, "extraction").where("kind = 'concept_drop'"), "extraction_id", "tags")
    i = cooccur.baskets(_t(spark, sf, "index_entry"), "entry_id", "tags")
    return materialise(cooccur.sets(c.select("items").unionAll(e.select("items")).unionAll(i.select("items"))), "tag-sets")


def p1_tag_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of tags: baskets that hold both, lift, and surprise under the null."""
    s = tag_sets(spark, sf)
    sizes = s.groupBy(F.size("items").alias("size")).agg(F.sum("w").alias("n"))
    n = s.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    r = cooccur.surprise(cooccur.pair_counts(s), cooccur.item_counts(s), sizes, n)
    return r.select(F.col("a").alias("tag_a"), F.col("b").alias("tag_b"), "n_ab", "n_a", "n_b", "lift", "expected", "log10_p", "q", F.lit(n).alias("n_baskets"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    r = p1_tag_pairs(spark, sf)
    often = (F.col("n_ab") >= MIN_TOGETHER) & (F.col("n_ab") >= F.lit(MIN_SHARE) * F.col("n_baskets"))
    return r.where(often & (F.col("n_ab") * F.col("n_baskets") >= MIN_LIFT * F.col("n_a") * F.col("n_b"))).select("tag_a", "tag_b")


def p1_pair_counts(spark: SparkSession, sf: str) -> DataFrame:
    return cooccur.pair_counts(tag_sets(spark, sf)).select(F.col("a").alias("tag_a"), F.col("b").alias("tag_b"), "n_ab")


_TAG = r"""regexp_replace(regexp_replace(regexp_replace(lower(t), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '^#\s*', ''), '[\s\p{Z}_-]+', '-', 'g')"""
_P1 = f"""WITH raw AS (
  SELECT DISTINCT 'c' AS src, classification_id AS id, unnest(tags) AS t FROM classification
  UNION ALL SELECT 'e', extraction_id, unnest(tags) FROM extraction WHERE kind = 'concept_drop'
  UNION ALL SELECT 'i', entry_id, unnest(tags) FROM index_entry),
it AS (SELECT DISTINCT src, id, {_TAG} AS tag FROM raw WHERE t IS NOT NULL),
ok AS (SELECT * FROM it WHERE tag NOT IN ('', '-')),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT src, id FROM ok)),
f AS (SELECT tag, count(*) AS c FROM ok GROUP BY tag),
p AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_ab FROM ok a JOIN ok b ON a.src = b.src AND a.id = b.id AND a.tag < b.tag GROUP BY ALL)
"""

# ---- 3: percentiles --------------------------------------------------------------


def latency_values(trace: DataFrame) -> DataFrame:
    """(day, target_kind, metric, value) of the usable durations and stage latencies."""
    kind = F.regexp_replace(F.lower(F.trim("target_kind")), r"[-\s]+", "_")
    whole = F.array(F.struct(F.lit("duration_ms").alias("metric"), F.col("duration_ms").alias("value")))
    stages = F.transform(F.map_entries("stage_latency_ms"), lambda e: F.struct(F.concat(F.lit("stage:"), e["key"]).alias("metric"), e["value"].alias("value")))
    all_values = F.concat(whole, F.coalesce(stages, F.slice(whole, 1, 0)))
    return (
        trace.select(
            F.date_format("received_at", "yyyy-MM-dd").alias("day"),
            F.coalesce(F.nullif(kind, F.lit("")), F.lit("(none)")).alias("target_kind"),
            F.explode(all_values).alias("m"),
        )
        .select("day", "target_kind", "m.metric", "m.value")
        .where(F.col("value").between(0, LONGEST_MS))
    )


def p3_daily_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """The form that is kept per day and combined later."""
    return quantiles.sketch(latency_values(_t(spark, sf, "pipeline_record")), ["day", "target_kind", "metric"])


def p3_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """All days combined."""
    keys = ["target_kind", "metric"]
    return quantiles.percentiles(quantiles.merge(p3_daily_buckets(spark, sf), keys), keys)


def p3_daily_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.percentiles(p3_daily_buckets(spark, sf), ["day", "target_kind", "metric"])


_LN = repr(math.log(quantiles.gamma()))
_G = repr(quantiles.gamma())
_P3_BUCKETS = f"""WITH v AS (SELECT strftime(received_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day,
  coalesce(nullif(regexp_replace(lower(trim(target_kind)), '[-\\s]+', '_', 'g'), ''), '(none)') AS target_kind,
  unnest(list_concat([{{'metric': 'duration_ms', 'value': duration_ms}}],
    coalesce(list_transform(map_entries(stage_latency_ms), lambda e: {{'metric': 'stage:' || e.key, 'value': e.value}}), []))) AS m
  FROM pipeline_record),
u AS (SELECT day, target_kind, m.metric AS metric, m.value AS value FROM v WHERE m.value BETWEEN 0 AND {LONGEST_MS}),
b AS (SELECT day, target_kind, metric, CAST(sign(value) AS INT) AS sign,
  CASE WHEN value = 0 THEN 0 ELSE CAST(ceil(ln(abs(value)) / {_LN}) AS INT) END AS i FROM u)
"""


def _p3_sql(keys: str) -> str:
    rank = lambda q: f"min_by(mid, upto) FILTER (WHERE upto >= ceil({q} * total))"
    return f"""{_P3_BUCKETS}, s AS (SELECT {keys}, sign, i, count(*) AS n FROM b GROUP BY {keys}, sign, i),
c AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY sign, sign * i ROWS UNBOUNDED PRECEDING) AS upto,
  sum(n) OVER (PARTITION BY {keys}) AS total, sign * (2 / ({_G} + 1)) * pow({_G}, i) AS mid FROM s)
SELECT {keys}, CAST(max(total) AS BIGINT) AS n, {rank(0.5)} AS p50, {rank(0.95)} AS p95, {rank(0.99)} AS p99 FROM c GROUP BY {keys}"""


# ---- 4: free-entered life areas --------------------------------------------------


def _areas(spark: SparkSession, sf: str) -> DataFrame:
    """(source_table, row_id, list_pos, value), once per place."""
    c = _t(spark, sf, "classification").where("classification_id is not null").select(F.lit("classification").alias("source_table"), F.col("classification_id").alias("row_id"), F.lit(0).alias("list_pos"), F.col("life_area").alias("value"))
    v = _t(spark, sf, "vault_config").select(F.lit("vault_config").alias("source_table"), F.col("vault_id").alias("row_id"), F.posexplode("life_categories").alias("p", "value"))
    return c.where("value is not null").distinct().unionAll(v.select("source_table", "row_id", (F.col("p") + 1).alias("list_pos"), "value"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    areas = _t(spark, sf, "life_category")
    names = F.concat(F.array("life_category", "title"), F.coalesce("aliases", F.array().cast("array<string>")))
    entries = areas.select(F.col("life_category").alias("entry"), F.explode(names).alias("name")).where("name is not null")
    r = canonical.map_values(_areas(spark, sf), entries, areas.select(F.col("life_category").alias("entry")), "value")
    return r.select("source_table", "row_id", "list_pos", F.col("entry").alias("life_category")).distinct()


# ---- 5: personal information -----------------------------------------------------

#: Only for tests: a deployment passes its own key.
DEMO_KEY = b"quillspark-demo"


def _personal(spark: SparkSession, sf: str) -> DataFrame:
    """(source_table, row_key, text) of the texts that may hold personal information."""
    f = _t(spark, sf, "eval_fixture").where("category = 'life'").select(F.lit("eval_fixture").alias("source_table"), F.col("id").alias("row_key"), F.col("input.text").alias("text"))
    e = _t(spark, sf, "extraction").where("kind in ('personal_log', 'life_entry')").select(F.lit("extraction").alias("source_table"), F.col("extraction_id").cast("string").alias("row_key"), F.col("content").alias("text"))
    return f.unionAll(e)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    names = pii.load_names(_t(spark, sf, "name_part"))
    return pii.findings(_personal(spark, sf), names, "text", "source_table", "row_key").distinct()


def p5_masked(spark: SparkSession, sf: str) -> DataFrame:
    """The same texts with every finding replaced by its placeholder."""
    return pii.masked(_personal(spark, sf), pii.load_names(_t(spark, sf, "name_part")), DEMO_KEY, "text")


# ---- 6: new batches against history ----------------------------------------------


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """The table admitted in its own batches, one per harvest, each against the index of those before."""
    rows = _t(spark, sf, "harvested_fixture").select(
        F.col("fixture_no").alias("no"), F.col("source_harvest_id").alias("arrival"), F.col("source_drop_id").alias("origin"), F.col("input.text").alias("text")
    )
    return history.admit_all(rows, F.col("arrival"))


# ---- 7: containers ---------------------------------------------------------------


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_t(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


# ---- 8: leaked evaluation texts --------------------------------------------------


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    fixtures = _t(spark, sf, "eval_fixture").select("id", F.col("input.text").alias("text"))
    return leakage.leaks(_t(spark, sf, "documents"), fixtures, "doc_id", "text", "id", "text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select(F.col("doc").alias("doc_id"), F.col("item").alias("fixture_id"))


def p8_leak_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The longest shared run of words of each leak."""
    return _leaks(spark, sf).select(F.col("doc").alias("doc_id"), F.col("item").alias("fixture_id"), "run", "start")


# ---- 9: look-alike texts ---------------------------------------------------------


def _looks(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of all texts, made in one pass and kept: 32 bytes a document."""
    return materialise(lookalike.look_keys(_t(spark, sf, "documents")), "look-keys")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    found = lookalike.pairs(_looks(spark, sf))
    return found.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p9_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.normalized(_t(spark, sf, "documents"))


def p9_classes(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.classes(_looks(spark, sf)).withColumnRenamed("id", "doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_tag_pairs": p1_tag_pairs,
    "p1_pair_counts": p1_pair_counts,
    "p3_daily_buckets": p3_daily_buckets,
    "p3_percentiles": p3_percentiles,
    "p3_daily_percentiles": p3_daily_percentiles,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_masked": p5_masked,
    "p6_found": p6_found,
    "p7_containers": p7_containers,
    "p8_found": p8_found,
    "p8_leak_runs": p8_leak_runs,
    "p9_found": p9_found,
    "p9_normalized": p9_normalized,
    "p9_classes": p9_classes,
}
SQL = {
    "p1_found": f"""{_P1} SELECT tag_a, tag_b FROM p JOIN f x ON x.tag = tag_a JOIN f y ON y.tag = tag_b, n
 WHERE n_ab >= {MIN_TOGETHER} AND n_ab >= {MIN_SHARE} * n.n AND n_ab * n.n >= {MIN_LIFT} * x.c * y.c""",
    "p1_pair_counts": f"{_P1} SELECT tag_a, tag_b, n_ab FROM p",
    "p3_daily_buckets": f"{_P3_BUCKETS} SELECT day, target_kind, metric, sign, i, count(*) AS n FROM b GROUP BY ALL",
    "p3_percentiles": _p3_sql("target_kind, metric"),
    "p3_daily_percentiles": _p3_sql("day, target_kind, metric"),
}
