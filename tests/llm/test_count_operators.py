"""Co-occurrence, percentile and history operators."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest

pytest.importorskip("quillspark.llm")

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import cooccur, history, quantiles

# ---- items that appear together --------------------------------------------------


def _baskets(spark, rows):
    return spark.createDataFrame([(k, t, "x") for k, t in rows], "id long, tags array<string>, items string")


def test_items_are_cleaned(spark):
    rows = [(1, ["Cedar Tooling", "#cedar_tooling", " cedar-tooling\t", None, "", " ", "B"]), (1, ["b", "c"]), (2, None), (3, []), (None, ["z"]), (4, ["b"]), (4, ["b"])]
    b = cooccur.union_repeats(cooccur.baskets(_baskets(spark, rows), "id", "tags"))
    assert {r.basket: r["items"] for r in b.collect()} == {1: ["b", "c", "cedar-tooling"], 4: ["b"]}


def test_pair_counts_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [f"t{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randint(0, 8))]) for i in range(400)] + [(1000, [f"w{i}" for i in range(300)])]
    s = cooccur.sets(cooccur.union_repeats(cooccur.baskets(_baskets(spark, rows), "id", "tags")))
    want = Counter(p for _, t in rows for p in combinations(sorted(set(t)), 2))
    assert {(r.a, r.b): r.n_ab for r in cooccur.pair_counts(s).collect()} == dict(want)
    assert {r.item: r.n for r in cooccur.item_counts(s).collect()} == dict(Counter(x for _, t in rows for x in set(t)))
    assert cooccur.pair_counts(s.where("false")).count() == 0


def test_fit_meets_the_degrees():
    d, c, s, m = np.array([2.0, 5, 40]), np.array([20.0, 8, 1]), np.array([1.0, 2, 6]), np.array([20.0, 20, 10])
    d = d * (s * m).sum() / (d * c).sum()
    x, y = cooccur.fit(d, c, s, m)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose(p @ m, d, rtol=1e-6) and np.allclose(c @ p, s, rtol=1e-6)


def test_tail_is_close_to_the_exact_one():
    rng = np.random.default_rng(1)
    for _ in range(8):
        m, q = rng.integers(5, 200, 4).astype(float), rng.uniform(0.001, 0.2, 4)
        pmf = np.array([1.0])
        for n, p in zip(m, q):
            for _ in range(int(n)):
                pmf = np.convolve(pmf, [1 - p, p])
        for k in (int((m * q).sum()) + 2, int((m * q).sum() * 1.5) + 3):
            exact = math.log10(pmf[k:].sum())
            assert abs(cooccur.upper_tail(np.array([k]), q[None, :], m)[0] - exact) < 0.03 * abs(exact) + 0.03
    assert cooccur.upper_tail(np.array([0]), np.array([[0.5]]), np.array([3.0]))[0] == 0


def test_surprise_finds_the_planted_pair(spark):
    rng = random.Random(4)
    rows = [(i, [f"t{rng.randrange(40)}" for _ in range(3)] + (["x", "y"] if i % 20 == 0 else [])) for i in range(600)]
    s = cooccur.sets(cooccur.union_repeats(cooccur.baskets(_baskets(spark, rows), "id", "tags"))).cache()
    sizes = s.selectExpr("size(items) as size", "w").groupBy("size").sum("w").toDF("size", "n")
    r = cooccur.surprise(cooccur.pair_counts(s), cooccur.item_counts(s), sizes, 600).toPandas()
    top = r.sort_values("q").iloc[0]
    assert (top.a, top.b, top.n_ab) == ("x", "y", 30) and top.q < 1e-6
    assert (r.q < 0.05).sum() <= 3 and r.q.between(0, 1).all() and (r.expected > 0).all()
    # adjusted values equal those of the plain procedure on the rounded p-values
    p = 10 ** (np.ceil(r.log10_p * cooccur.P_STEPS) / cooccur.P_STEPS)
    o = np.argsort(p.to_numpy(), kind="stable")
    n_items = cooccur.item_counts(s).count()
    raw = p.to_numpy()[o] * (n_items * (n_items - 1) / 2) / np.arange(1, len(p) + 1)
    want = np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
    assert np.allclose(r.q.to_numpy()[o], want, rtol=1e-6)


# ---- percentiles -----------------------------------------------------------------


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e9, 1e9, allow_nan=False), min_size=1, max_size=60))
def test_percentile_error_is_bounded(spark, values):
    df = spark.createDataFrame([("k", float(v)) for v in values], "k string, value double")
    got = quantiles.percentiles(quantiles.sketch(df, ["k"]), ["k"]).first()
    s = sorted(values)
    for q, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
        true = s[math.ceil(q * len(s)) - 1]
        assert abs(got[name] - true) <= quantiles.ERROR * abs(true) * (1 + 1e-9)
    assert got.n == len(values)


def test_sketches_of_parts_add_up(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.choice(["d1", "d2", None]), rng.choice([rng.lognormvariate(5, 2), 0.0, -3.0, 7.0]), 1) for _ in range(500)]
    rows += [("a", "d1", None, 1), ("a", "d1", float("nan"), 1), ("a", "d1", float("inf"), 1), ("c", "d1", None, 1)]
    df = spark.createDataFrame(rows, "k string, day string, value double, n int")
    whole = quantiles.percentiles(quantiles.sketch(df, ["k"]), ["k"]).collect()
    merged = quantiles.percentiles(quantiles.merge(quantiles.sketch(df, ["k", "day"]), ["k"]), ["k"]).collect()
    assert sorted(whole) == sorted(merged) and {r.k for r in whole} == {"a", "b"} and sum(r.n for r in whole) == 500
    assert quantiles.percentiles(quantiles.sketch(df.where("false"), ["k"]), ["k"]).count() == 0


# ---- history ---------------------------------------------------------------------


def brute(rows):
    kept, out = [], set()
    for no, _, origin, t in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is None, r[1] or "", r[0])):
        w = history.words_of(t) if t else []
        hit = next((k for k, o, v in kept if (origin is not None and o == origin) or (w and v and history.common_words(w, v) >= history.SIMILAR * max(len(w), len(v)))), None)
        if hit is None:
            kept.append((no, origin, w))
        else:
            out.add((hit, no))
    return out


def _texts(rng, n):
    words = [f"{a}{b}" for a in "bcdfghjklm" for b in ("an", "el", "ip", "or", "us", "ay")]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.4:
            w = rng.choice(rows)[3].split()
            for _ in range(rng.choice([0, 1, len(w) // 8, len(w) // 2])):
                w[rng.randrange(len(w))] = rng.choice(words)
            t = " ".join(w).upper() + rng.choice(["", "!", " project-x-3"])
        else:
            t = " ".join(rng.choice(words) for _ in range(rng.randint(12, 40)))
        rows.append((i, f"2024-01-{1 + i * 20 // n:02d}", rng.choice([None, f"o{rng.randrange(n)}"]), t))
    return rows


SCHEMA = "no long, arrival string, origin string, text string, cls long"


def test_history_equals_the_plain_loop(spark):
    rng = random.Random(7)
    rows = _texts(rng, 220)
    rows += [(900, "2024-01-25", None, None), (901, "2024-01-25", None, ""), (902, "2024-01-26", None, "!!"), (903, None, "o1", "late one"), (None, "2024-01-02", "o1", "x"), (904, "2024-01-25", None, "word " * 20_000), (905, "2024-01-25", None, "word " * 20_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    got = {tuple(r) for r in history.admit_all(df, df.arrival.substr(1, 9)).collect()}
    assert got == brute(rows) and len(got) > 30
    # batches give what one batch gives
    assert {tuple(r) for r in history.History(spark).admit(df).collect()} == got


def test_large_buckets_are_not_expanded_but_lose_nothing(spark, monkeypatch):
    """Many different near copies share buckets; two texts lead a bucket at a time."""
    monkeypatch.setattr(history, "LEADERS", 2)
    monkeypatch.setattr(history, "BOUND", 3)
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(40)}" for _ in range(24)) for _ in range(3)]
    rows = []
    for i in range(90):
        w = base[i % 3].split()
        for _ in range(rng.randint(0, 1)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(1000)}"
        rows.append((i, "d", rng.choice([None, f"o{rng.randrange(60)}"]), " ".join(w)))
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    assert {tuple(r) for r in history.History(spark).admit(df).collect()} == brute(rows)
    live = spark.createDataFrame([(1, c, c) for c in range(50)] + [(2, 1, 1), (2, 2, 2), (3, 9, 9)], "key long, cls long, at long")
    shared = history.shared_buckets(live)
    pairs, rest = history.led_pairs(shared, 2)
    assert pairs.count() == 2 * 49 and rest.count() == 48
    assert [tuple(r) for r in history.all_pairs(shared).collect()] == [(1, 2)]


def test_history_of_nothing(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert history.admit_all(e, e.arrival).count() == 0
    assert history.History(spark).admit(e).count() == 0


def test_hot_copies_take_few_rounds(spark):
    """A third of all rows are copies of one text, under different origins."""
    rows = [(i, "d", f"o{i}", "the same words again and again in every copy of it" if i % 3 == 0 else f"another text number {i} with words {i * 7} of {i * 13} its own {i * 17}") for i in range(300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    assert {tuple(r) for r in history.History(spark).admit(df).collect()} == {(0, i) for i in range(3, 300, 3)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_common_words_is_the_longest_common_subsequence(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert history.common_words(a, b) == t[-1][-1]
