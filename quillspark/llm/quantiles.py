"""Percentiles of large numeric columns from signed logarithmic buckets.

A value v lies in bucket (sign, i) with gamma**(i-1) < |v| <= gamma**i, where
gamma = (1 + error) / (1 - error); zero is a bucket of its own. Counts of equal
buckets add, so sketches of partitions, batches or days combine exactly. A
percentile is the midpoint 2*gamma**i / (gamma + 1) of the bucket that holds the
nearest rank ceil(q*n): within `error` of the true value, relatively.

Defined results: null, NaN and infinite values are left out; a group without usable
values has no row; negative values are counted with sign -1; order of rows and ties
do not matter; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERROR = 0.01


def gamma(error: float = ERROR) -> float:
    return (1 + error) / (1 - error)


def bucket(v: Column, error: float = ERROR) -> Column:
    """Struct (sign, i) of a value; i is 0 for zero."""
    log = F.ceil(F.log(F.abs(v)) / F.lit(math.log(gamma(error)))).cast("int")
    return F.struct(F.signum(v).cast("int").alias("sign"), F.when(v == 0, 0).otherwise(log).alias("i"))


def sketch(values: DataFrame, keys: Sequence[str], value: str = "value", error: float = ERROR) -> DataFrame:
    """(keys..., sign, i, n): bucket counts; combined on the map side, so that no key is hot."""
    v = F.col(value).cast("double")
    usable = values.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return usable.select(*keys, bucket(v, error).alias("b")).groupBy(*keys, "b.sign", "b.i").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of finer groups, added up to the given keys."""
    return sketches.groupBy(*keys, "sign", "i").agg(F.sum("n").alias("n"))


def percentiles(sk: DataFrame, keys: Sequence[str], qs: Sequence[float] = (0.5, 0.95, 0.99), error: float = ERROR) -> DataFrame:
    """(keys..., n, p<q>...): one row per group. The windows run over the buckets of a
    group, of which there are at most about 2 * 71,000 for all doubles at one per cent."""
    w = Window.partitionBy(*keys)
    upto = w.orderBy("sign", F.col("sign") * F.col("i")).rowsBetween(Window.unboundedPreceding, 0)
    g = gamma(error)
    mid = F.col("sign") * F.lit(2 / (g + 1)) * F.pow(F.lit(g), F.col("i"))
    c = sk.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(w)).withColumn("mid", mid)
    cols = [F.min_by("mid", F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("total")), F.col("upto"))).alias(f"p{q * 100:g}".replace(".", "_")) for q in qs]
    return c.groupBy(*keys).agg(F.max("total").alias("n"), *cols)
