"""Windowed latency statistics of pipeline traces."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.delivery import instant
from quillspark.session import materialise

#: Fixed value: the order in which stages are listed.
STAGES = ("orchestrator", "classifier", "extractor", "verifier", "writer")
QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
#: Width of the value ranges within which places are counted.
BUCKET = 1024
#: Fewer samples than this make high percentiles unreliable.
WARM_UP = 10


def in_window(trace: DataFrame, now: datetime, days: int) -> DataFrame:
    """Rows of the last `days` days before `now`, with `at`; unreadable times are left out."""
    since = F.lit((now - timedelta(days=max(1, min(90, days)))).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    return trace.withColumn("at", instant(F.col("ts"))).where(F.col("at") >= since)


def value_buckets(counts: DataFrame, *keys: str) -> DataFrame:
    """counts (keys..., v, n) with their place in the order of each key: `upto`, the rows
    up to and including v, and `total`. Values are cut into buckets of BUCKET, so that no
    task sorts a whole key: inner places within buckets, outer ones over bucket sums."""
    c = counts.withColumn("b", F.floor(F.col("v") / BUCKET))
    inner = Window.partitionBy(*keys, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy(*keys)
    sums = c.groupBy(*keys, "b").agg(F.sum("n").alias("m"))
    outer = sums.withColumn("before", F.sum("m").over(over.orderBy("b")) - F.col("m")).withColumn("total", F.sum("m").over(over))
    right = outer.select(*(F.col(k).alias(f"_{k}") for k in (*keys, "b")), "before", "total")
    same = F.lit(True)
    for k in (*keys, "b"):
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    j = c.withColumn("inner", F.sum("n").over(inner)).join(right, same)
    return j.select(*keys, "v", "n", (F.col("before") + F.col("inner")).alias("upto"), "total")


def quantiles(rows: DataFrame, value: str, *keys: str, qs: dict[str, float] = QUANTILES) -> DataFrame:
    """(keys..., n, mean, min, max, quantiles...): exact nearest-rank quantiles, the value at
    place ceil(q*n). Equal values are counted before the first shuffle and the places are
    found bucket by bucket, so one key may hold all rows. Null values are left out."""
    v = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    return quantiles_of(v.groupBy(*keys, "v").agg(F.count("*").alias("n")), *keys, qs=qs)


def quantiles_of(counts: DataFrame, *keys: str, qs: dict[str, float] = QUANTILES) -> DataFrame:
    """The same from counts (keys..., v, n) of different values."""
    p = value_buckets(counts, *keys)
    at = [F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("total")), F.col("v"))).alias(k) for k, q in qs.items()]
    mean = F.sum(F.col("v").cast("decimal(28,6)") * F.col("n")).cast("double") / F.sum("n")
    return p.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), mean.alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), *at)


def summary(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, quantiles, mean (cut to whole), min and max of the non-negative values; zeros
    where there are none. Values are cut to whole numbers first."""
    v = rows.where(F.col(value) >= 0).select(*keys, F.col(value).cast("long").alias("v"))
    out = quantiles(v, "v", *keys)
    whole = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in (*QUANTILES, "mean", "min", "max")]
    out = out.select(*keys, "n", *whole)
    return out if keys else out.withColumn("warming_up", F.col("n") < WARM_UP)


def stage_values(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode("stage_latency_ms").alias("stage", "ms"))


def stage_place(stage: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STAGES)), stage)


def by_stage(rows: DataFrame) -> DataFrame:
    """Summary per known stage, with its place; absent stages have no row."""
    s = summary(stage_values(rows).withColumn("place", stage_place(F.col("stage"))).where("place > 0"), "ms", "stage", "place")
    return s.orderBy("place")


def rates(rows: DataFrame) -> DataFrame:
    """Errors and escalations of all rows over the rows with a usable duration (so a rate
    can exceed one); null where there are none."""
    n = F.count_if(F.col("duration_ms") >= 0)
    blocked, raised = F.count_if(F.length("blocked_reason") > 0), F.count_if(F.col("escalated"))
    return rows.agg(n.alias("n"), blocked.alias("blocked"), raised.alias("escalated")).select(
        "n", "blocked", "escalated", (F.col("blocked") / F.nullif("n", F.lit(0))).alias("error_rate"), (F.col("escalated") / F.nullif("n", F.lit(0))).alias("escalation_rate")
    )


def kind_counts(rows: DataFrame) -> DataFrame:
    return rows.where("target_kind is not null").groupBy("target_kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target_kind")


def facts(rows: DataFrame) -> DataFrame:
    """(section, name, v, n): how often each figure of the report occurs, from one scan,
    counted before the shuffle. v is null where only the number matters."""
    none = F.lit(None).cast("long")

    def fact(section: str, name: Column, v: Column, keep: Column) -> Column:
        return F.when(keep, F.struct(F.lit(section).alias("section"), name.alias("name"), v.cast("long").alias("v")))

    ms = F.col("duration_ms")
    own = F.array(
        fact("latency", F.lit("all"), ms, ms >= 0),
        fact("rate", F.lit("error"), none, F.length("blocked_reason") > 0),
        fact("rate", F.lit("escalation"), none, F.col("escalated")),
        fact("kind", F.col("target_kind"), none, F.col("target_kind").isNotNull()),
    )
    known = F.filter(F.map_entries("stage_latency_ms"), lambda e: (e["value"] >= 0) & e["key"].isin(*STAGES))
    stages = F.transform(known, lambda e: fact("stage", e["key"], e["value"], F.lit(True)))
    every = F.array_compact(F.concat(own, F.coalesce(stages, F.slice(own, 1, 0))))
    return rows.select(F.explode(every).alias("f")).select("f.*").groupBy("section", "name", "v").agg(F.count("*").alias("n"))


def report(rows: DataFrame) -> DataFrame:
    """The whole report as (section, name, n, p50, p95, p99, mean, share): a summary of all
    durations, one per stage, the two rates and the histogram of kinds; 0 where a figure
    does not apply. The rows are scanned once; the rest works on the counted facts."""
    f = materialise(facts(rows), "stats-facts")
    q = quantiles_of(f.where("v is not null"), "section", "name")
    sums = f.groupBy("section", "name").agg(F.sum("n").alias("hits"))
    always = rows.sparkSession.createDataFrame([("latency", "all"), ("rate", "error"), ("rate", "escalation")], "section string, name string")
    names = sums.select("section", "name").union(always).distinct()
    usable = f.where("section = 'latency'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    j = names.join(sums, ["section", "name"], "left").join(q.drop("n"), ["section", "name"], "left")
    rate = F.col("section") == "rate"
    share = F.coalesce(F.when(rate & (F.lit(usable) > 0), F.coalesce("hits", F.lit(0)) / F.lit(usable)), F.lit(0.0))
    n = F.when(rate, F.lit(usable)).otherwise(F.coalesce("hits", F.lit(0)))
    return j.select("section", "name", n.alias("n"), *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in (*QUANTILES, "mean")), share.alias("share"))
