"""Items that appear together: exact pair counts, compared with a bipartite
configuration null.

Null model: the maximum-entropy bipartite graph whose expected degrees are the observed
item frequencies and basket sizes, p(item i, basket b) = x_i y_b / (1 + x_i y_b). All
items of one frequency share x, all baskets of one size share y, so the fit runs on the
two degree tables; an item frequency table of M incidences has at most sqrt(2M) distinct
values, and so has the size table. Under the null the number of baskets that hold two
items is Poisson-binomial; its upper tail is taken by a saddle point with continuity
correction and p-values go through Benjamini-Hochberg over all pairs of items.

Pairs are counted by identical baskets first (a weight each), then combined on the map
side; no basket or item is gathered into one task.

Defined results: null and empty lists and null or blank items are no part of a basket, a
basket without items is none; an item counts once per basket; rows with a null basket id
are left out; extra columns are ignored; an empty table gives no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Resolution at which log10 p-values are rounded up before the false-discovery step.
P_STEPS, P_FLOOR = 1000, -300


def clean_item(tag: Column) -> Column:
    """Lower case, outer blanks and one leading # gone, words joined by single hyphens."""
    t = F.regexp_replace(F.regexp_replace(F.lower(tag), r"(?U)^\s+|\s+$", ""), r"(?U)^#\s*", "")
    return F.regexp_replace(t, r"(?U)[\s_-]+", "-")


def baskets(rows: DataFrame, key: str, tags: str) -> DataFrame:
    """(basket, items): sorted distinct cleaned items; rows of one key are one basket."""
    items = F.filter(F.transform(F.coalesce(F.col(tags), F.array().cast("array<string>")), lambda t: clean_item(t)), lambda t: t.isNotNull() & (t != "") & (t != "-"))
    return rows.where(F.col(key).isNotNull()).select(F.col(key).alias("basket"), F.array_sort(F.array_distinct(items)).alias("items")).where(F.size("items") > 0)


def union_repeats(b: DataFrame) -> DataFrame:
    """One row per basket: its distinct item lists joined (repeated rows count once)."""
    once = b.distinct()
    merged = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    return once.groupBy("basket").agg(merged.alias("items"))


def sets(b: DataFrame) -> DataFrame:
    """(items, w): identical baskets with their number."""
    return b.groupBy("items").agg(F.count("*").alias("w"))


def item_counts(s: DataFrame) -> DataFrame:
    return s.select(F.explode("items").alias("item"), "w").groupBy("item").agg(F.sum("w").alias("n"))


def pair_counts(s: DataFrame) -> DataFrame:
    """(a, b, n_ab), a < b: exact. Each set emits one row per item with the rest of its
    list, then one row per pair, so memory stays linear in the basket."""
    rest = s.where(F.size("items") > 1).select(F.posexplode("items").alias("at", "a"), "items", "w")
    tails = rest.select("a", F.expr("slice(items, at + 2, size(items))").alias("tail"), "w")
    return tails.select("a", F.explode("tail").alias("b"), "w").groupBy("a", "b").agg(F.sum("w").alias("n_ab"))


def fit(degrees: np.ndarray, multiplicity: np.ndarray, sizes: np.ndarray, baskets_of: np.ndarray, rounds: int = 2000, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """x per distinct item frequency, y per distinct basket size, by fixed-point iteration; an
    iteration that does not come to rest (relative change below 1e-6) is an error."""
    total = float((degrees * multiplicity).sum())
    x, y = degrees / np.sqrt(total), sizes / np.sqrt(total)
    blocks = [slice(i, i + 4096) for i in range(0, len(x), 4096)]  # bounds the memory of the product
    for _ in range(rounds):
        nx = np.concatenate([degrees[b] / (baskets_of * y / (1 + np.outer(x[b], y))).sum(axis=1) for b in blocks])
        ny = sizes / sum((multiplicity[b] * nx[b] / (1 + np.outer(y, nx[b]))).sum(axis=1) for b in blocks)
        gap = max(np.abs(nx / x - 1).max(), np.abs(ny / y - 1).max())
        x, y = nx, ny
        if gap < tol:
            break
    else:
        if not gap < 1e-6:
            raise RuntimeError(f"the null model did not come to rest in {rounds} rounds: relative change {gap:.1e}")
    return x, y


def upper_tail(k: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """log10 P(S >= k) for S a sum of m[c] independent Bernoulli(q[r, c]); one row per
    k. Second-order saddle point for lattice variables; exactly 0 where k is at or below
    the mean, an upper bound there."""
    mean = (m * q).sum(axis=1)
    out = np.zeros(len(k))
    rows = np.flatnonzero((k > mean) & (k <= m.sum()))
    if len(rows):
        kk, qq = k[rows].astype(float), q[rows]
        target = np.minimum(kk, m.sum() - 1e-6)
        t = np.log(np.maximum(target / np.maximum(mean[rows], 1e-300), 1 + 1e-12))
        for _ in range(60):  # Newton for K'(t) = k
            e = qq * np.exp(np.minimum(t, 700))[:, None]
            r = e / (1 - qq + e)
            step = ((m * r).sum(axis=1) - target) / np.maximum((m * r * (1 - r)).sum(axis=1), 1e-300)
            t = np.maximum(t - np.clip(step, -2, 2), 1e-12)
            if np.abs(step).max() < 1e-10:
                break
        e = qq * np.exp(np.minimum(t, 700))[:, None]
        r = e / (1 - qq + e)
        k2 = np.maximum((m * r * (1 - r)).sum(axis=1), 1e-300)
        cgf = (m * np.log1p(qq * np.expm1(np.minimum(t, 700))[:, None])).sum(axis=1)
        # lattice tail of an exponentially tilted sum: exp(K - t k) * B0, B0 for step one
        lam = t * np.sqrt(k2)
        mills = _scaled_tail(lam) * lam / -np.expm1(-t)
        out[rows] = np.minimum(0, (cgf - t * target + np.log(np.maximum(mills / np.sqrt(k2), 1e-300))) / np.log(10))
    out[k > m.sum()] = -np.inf
    return out


def _scaled_tail(z: np.ndarray) -> np.ndarray:
    """exp(z^2/2) * (1 - Phi(z)), stable for large z (continued fraction beyond 5)."""
    from math import erfc

    near = np.array([0.5 * erfc(v / np.sqrt(2)) * np.exp(v * v / 2) if v < 5 else 0.0 for v in z])
    f = np.zeros_like(z)
    for i in range(40, 0, -1):
        f = i / (z + f)
    return np.where(z < 5, near, 1 / ((z + f) * np.sqrt(2 * np.pi)))


def surprise(pairs: DataFrame, items: DataFrame, sizes: DataFrame, n_baskets: int) -> DataFrame:
    """pairs (a, b, n_ab) with n_a, n_b, expected, log10_p, q: expectation under the null,
    its tail and the false-discovery-adjusted value over all pairs of items.

    sizes: (size, n) distinct basket sizes. Only degree tables reach the driver."""
    deg = items.groupBy("n").agg(F.count("*").alias("c")).orderBy("n").toPandas()
    siz = sizes.orderBy("size").toPandas()
    d, c, s, m = (np.asarray(v, dtype=float) for v in (deg["n"], deg["c"], siz["size"], siz["n"]))
    if len(d):
        x, y = fit(d, c, s, m)
    place = {int(v): i for i, v in enumerate(d)}
    tests = float(c.sum() * (c.sum() - 1) / 2)

    def tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def prob(n: pd.Series) -> np.ndarray:
            xy = x[[place[int(v)] for v in n]][:, None] * y[None, :]
            return xy / (1 + xy)

        for b in batches:
            if len(b):
                q = prob(b.n_a) * prob(b.n_b)
                p = np.maximum(upper_tail(b.n_ab.to_numpy(), q, m), P_FLOOR)
                b = b.assign(expected=(q * m).sum(axis=1), log10_p=p, step=np.ceil(p * P_STEPS).astype("int32"))
                yield b

    with_n = pairs.join(items.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a").join(items.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b")
    t = with_n.select("a", "b", "n_ab", "n_a", "n_b").mapInPandas(tail, "a string, b string, n_ab long, n_a long, n_b long, expected double, log10_p double, step int")
    # Benjamini-Hochberg over at most P_STEPS * -P_FLOOR + 1 distinct rounded p-values
    up = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    h = t.groupBy("step").agg(F.count("*").alias("c")).withColumn("rank", F.sum("c").over(up))
    h = h.withColumn("raw", F.pow(F.lit(10.0), F.col("step") / P_STEPS) * F.lit(tests) / F.col("rank"))
    h = h.select("step", F.least(F.lit(1.0), F.min("raw").over(down)).alias("q"))
    lift = F.col("n_ab") * F.lit(float(n_baskets)) / (F.col("n_a") * F.col("n_b"))
    return t.join(h, "step").drop("step").withColumn("lift", lift)
