"""Mapping free-entered values to a canonical list, by a prefix-filter set-similarity join.

Every name, title and alias of the list becomes a few records: its words in order, its
words sorted, its words run together, its consonants, its bag of letters, and its truncations. Values get
the records that need no truncation. A record is a set of character grams. Grams are
ordered by global rarity (over both sides); two sets can reach Jaccard >= t only if
their prefixes of |s| - ceil(t|s|) + 1 rarest grams share one, so only those are joined,
filtered by length and by position, verified exactly, and the best entry is kept.

Defined results: null and blank values are left out; an entry's own spelling is no case;
a value that reaches no entry, or has no letter, maps to the empty string; equal scores
are settled by the smaller entry name; equal values are matched once; extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import materialise, maybe_broadcast

#: Least Jaccard of whole forms, of consonant forms, of truncated forms and of letter bags.
THRESHOLD = {"w": 0.4, "c": 0.75, "t": 0.8, "l": 0.84}
#: Least letters of a form of each kind.
LEAST = {"w": 3, "c": 4, "t": 4, "l": 9}
#: A truncation keeps at least this many letters and this share of the name.
CUT_LETTERS, CUT_SHARE = 5, 0.45
# Additions around a value that say nothing.
_WRAP = re.compile(r"^(?:area|topic|category|my|the)\b[:\s]+|^life/|^#|\.md$|\(misc\)|\s(?:stuff|things|etc|&\s*co|and co)\W*$")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_VOWELS = re.compile("[aeiou]")


def plain(value: str, unwrap: bool = True) -> str:
    """Lower-case words of the value without accents, additions and punctuation."""
    v = _CAMEL.sub(" ", value.strip())
    v = "".join(c for c in unicodedata.normalize("NFKD", v.lower()) if not unicodedata.combining(c)).strip()
    before = None
    while unwrap and before != v:
        before, v = v, _WRAP.sub("", v).strip()
    return " ".join(re.findall(r"[a-z0-9]+", v))


def grams(text: str, kind: str) -> list[str]:
    """Padded bigrams of a form (single letters of a bag), marked with the kind; repeated
    grams get numbers, so that sets stand for multisets."""
    p, seen, out = f"^{text}$", {}, []
    for g in text if kind == "l" else (p[i : i + 2] for i in range(len(p) - 1)):
        seen[g] = n = seen.get(g, 0) + 1
        out.append(f"{kind}{g}{n if n > 1 else ''}")
    return out


def value_forms(text: str) -> list[tuple[str, str]]:
    words = text.split(" ")
    forms = [("w", text), ("w", " ".join(sorted(words))), ("w", "".join(words)), ("c", _VOWELS.sub("", text)), ("t", text), ("l", "".join(sorted(text.replace(" ", ""))))]
    return [f for f in dict.fromkeys(forms) if len(f[1]) >= LEAST[f[0]]]


def entry_forms(text: str) -> list[tuple[str, str]]:
    cuts = [text[:n].rstrip() for n in range(max(CUT_LETTERS, math.ceil(CUT_SHARE * len(text))), len(text))]
    first = [f for f in value_forms(text) if f[0] != "t"]
    return first + [("t", c) for c in dict.fromkeys(cuts)]


def _forms(side):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: [{"kind": k, "form": f, "grams": grams(f, k)} for k, f in dict.fromkeys(x for p in {plain(t), plain(t, False)} if p for x in side(p))])

    return F.pandas_udf(run, "array<struct<kind:string,form:string,grams:array<string>>>")


def _records(distinct: DataFrame, text: str, side, keep: list[str]) -> DataFrame:
    r = distinct.select(*keep, F.explode(_forms(side)(F.col(text))).alias("f"))
    return r.select(*keep, "f.kind", "f.form", "f.grams")


def _ordered(records: DataFrame, rank: DataFrame, keep: list[str]) -> DataFrame:
    """Grams of each record in order of global rarity."""
    g = records.select(*keep, "kind", "form", F.explode("grams").alias("gram")).join(rank, "gram")
    return g.groupBy(*keep, "kind", "form").agg(F.array_sort(F.collect_list(F.struct("freq", "gram"))).alias("o")).withColumn("o", F.col("o.gram"))


def _prefixes(ordered: DataFrame, keep: list[str]) -> DataFrame:
    t = F.create_map(*(x for k, v in THRESHOLD.items() for x in (F.lit(k), F.lit(v))))[F.col("kind")]
    n = F.size("o")
    p = n - F.ceil(t * n - F.lit(1e-9)).cast("int") + 1
    return ordered.select(*keep, "kind", "form", "o", n.alias("n"), t.alias("t"), F.posexplode(F.slice("o", 1, p)).alias("pos", "gram"))


def match(values: DataFrame, entries: DataFrame) -> DataFrame:
    """values (value) distinct, entries (entry, name): (value, entry, score) of the best
    entry of each value that has one."""
    v = materialise(_records(values, "value", value_forms, ["value"]), "canonical-values")
    e = materialise(_records(entries, "name", entry_forms, ["entry"]).distinct(), "canonical-entries")
    rank = v.select(F.explode("grams").alias("gram")).unionAll(e.select(F.explode("grams").alias("gram"))).groupBy("gram").agg(F.count("*").alias("freq"))
    rank = maybe_broadcast(rank)
    vp = _prefixes(_ordered(v, rank, ["value"]), ["value"])
    ep = _prefixes(_ordered(e, rank, ["entry"]), ["entry"]).select("entry", "kind", "gram", F.col("form").alias("form_e"), F.col("o").alias("o_e"), F.col("n").alias("n_e"), F.col("pos").alias("pos_e"))
    j = vp.join(maybe_broadcast(ep), ["kind", "gram"])
    need = F.ceil(F.col("t") / (1 + F.col("t")) * (F.col("n") + F.col("n_e")) - F.lit(1e-9))
    length = (F.col("n_e") >= F.col("t") * F.col("n")) & (F.col("n") >= F.col("t") * F.col("n_e"))
    place = 1 + F.least(F.col("n") - F.col("pos") - 1, F.col("n_e") - F.col("pos_e") - 1) + F.least("pos", "pos_e") >= need
    c = j.where(length & place).select("value", "entry", "kind", "t", "o", "o_e").distinct()
    shared = F.size(F.array_intersect("o", "o_e"))
    jaccard = shared / (F.size("o") + F.size("o_e") - shared)
    scored = c.withColumn("jaccard", jaccard).where(F.col("jaccard") >= F.col("t"))
    # whole forms first at equal score; a truncation says least
    weight = F.col("jaccard") * F.when(F.col("kind") == "w", 1.0).when(F.col("kind") == "c", 0.97).when(F.col("kind") == "t", 0.94).otherwise(0.7)
    order = Window.partitionBy("value").orderBy(F.desc("score"), "entry")
    # per value at most one row per entry of the list goes into the window
    each = scored.groupBy("value", "entry").agg(F.max(F.round(weight, 9)).alias("score"))
    return each.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def map_values(rows: DataFrame, entries: DataFrame, names: DataFrame, value: str) -> DataFrame:
    """rows with `entry`: the matched entry or ''. names: (entry) spellings that are no
    case; their rows are dropped, as are null and blank values. Distinct values are
    matched once, then joined back; a column named entry is replaced."""
    cases = rows.where(F.col(value).isNotNull() & (F.length(F.regexp_replace(value, r"(?U)\s+", "")) > 0)).join(maybe_broadcast(names.select(F.col("entry").alias(value)).distinct()), value, "left_anti")
    distinct = cases.select(F.col(value).alias("value")).distinct()
    found = match(distinct, entries).select(F.col("value").alias(value), F.col("entry").alias("_entry"))
    return cases.drop("_entry").join(found, value, "left").withColumn("entry", F.coalesce("_entry", F.lit(""))).drop("_entry")
