"""Evaluation texts leaking into training text, by a distributed positional inverted index.

1. Every training text becomes the sequence of its spoken words (no cue numbers,
   timings, markup, speaker labels, sound descriptions), folded so that letter case,
   accents, look-alike and commonly misread characters do not matter.
2. Postings (term, doc, position) of the terms of the test vocabulary are stored.
3. Of each window of `words` test words the `anchors` rarest terms are looked up; a
   posting at position p of an anchor at test position q votes for offset p - q, and
   the offset-adjusted lists are intersected: `votes` anchors must agree on an offset.
4. Each (doc, test item, offset) so found is verified word by word: the longest run of
   equal words decides (exact phrase), words within one edit count as equal (proximity).

Cues that are stored out of order are read both in stored and in start-time order.

Defined results: null or empty texts, and test items with fewer words than the window,
match nothing; repeated rows give one result row; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.lookalike import skeleton
from quillspark.session import BROADCAST_ROWS, materialise, maybe_broadcast

_TIMING = re.compile(r"^[^\S\n]*(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{1,3})[^\S\n]*-{1,2}>.*$", re.M)
_CUE_NO = re.compile(r"\n[^\S\n]*\d+[^\S\n]*\n*\Z")
_MARKUP = re.compile(r"<[^<>\n]+>|\{\\[^{}\n]*\}")
# [bracketed] anywhere, and lines wholly in parentheses, asterisks or note signs
_SOUND = re.compile(r"\[[^\[\]\n]*\]|^[^\S\n]*[-–]?[^\S\n]*(?:\([^()\n]*\)|\*[^*\n]*\*|[♪♫][^\n]*)[^\S\n]*$", re.M)
_SPEAKER = re.compile(r"^[^\S\n]*[-–]?[^\S\n]*[^\W\d_a-z][^\Wa-z]*(?:[ .][^\W\d_a-z][^\Wa-z]*){0,2}:[^\S\n]", re.M)
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[̀-ͯ]")
#: Characters that recognition confuses, and the class they are folded to.
FOLD_ONE = str.maketrans({"0": "o", "1": "l", "i": "l", "c": "e", "h": "ll", "m": "rn", "w": "vv", "5": "s"})
_MOJIBAKE = re.compile("[ÂÃÐÑâ][\u0080-ÿŒ-™]")


def _undo(text: str) -> str:
    for page in ("cp1252", "latin-1"):
        try:
            return text.encode(page).decode("utf-8")
        except UnicodeError:
            continue
    return text


def _repair(text: str) -> str:
    """Text that was UTF-8 but was decoded as a single-byte code page, once or twice,
    undone as a whole if it can be, else line by line."""
    for _ in range(2):
        if not _MOJIBAKE.search(text):
            break
        whole = _undo(text)
        text = whole if whole != text else "\n".join(_undo(x) if _MOJIBAKE.search(x) else x for x in text.split("\n"))
    return text


class _Folded(dict):
    """Folded form by word; forgets all when it holds too many."""

    def __missing__(self, word: str) -> str:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = f = word.translate(FOLD_ONE).replace("fl", "tl")
        return f


_FOLDED = _Folded()


def fold_words(text: str) -> list[str]:
    """Folded words of already cleaned text."""
    t = text
    if not t.isascii():
        t = _MARKS.sub("", skeleton(t))
    fold = _FOLDED.__getitem__
    return [fold(w) for w in _WORD.findall(t.lower().replace("'", ""))]


def _clean(text: str) -> str:
    return _SPEAKER.sub("", _SOUND.sub(" ", _MARKUP.sub("", text)))


def spoken(text: str) -> list[list[str]]:
    """Word sequences of a subtitle text: in stored order, and in start-time order if
    that differs. A text without timings is one sequence."""
    t = _repair(text.replace("\r\n", "\n").replace("\r", "\n"))
    if not t.isascii():
        t = skeleton(t)
    cuts = list(_TIMING.finditer(t))
    if not cuts:
        return [fold_words(_clean(t))]
    starts = [((int(m[1] or 0) * 60 + int(m[2])) * 60 + int(m[3])) * 1000 + int(m[4]) for m in cuts]
    ends = [m.start() for m in cuts[1:]] + [len(t)]
    cues = [_CUE_NO.sub("\n", t[m.end() : e]) for m, e in zip(cuts, ends, strict=True)]
    stored = fold_words(_clean("\n".join(cues)))
    if all(a <= b for a, b in zip(starts, starts[1:], strict=False)):
        return [stored]
    order = sorted(range(len(cues)), key=starts.__getitem__)
    return [stored, fold_words(_clean("\n".join(cues[i] for i in order)))]


def _spoken_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: [" ".join(x) for x in spoken(t)])


def test_words(text: str) -> str:
    """Words of a test item, parted by blanks; the parts that punctuation makes of one
    word (as in a mail address) are joined by underscores, so that it counts as one."""
    words = ("_".join(fold_words(w)) for w in _clean(text).split())
    return " ".join(w for w in words if w)


def _plain_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(test_words)


def spoken_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, reading, words): one row per reading of each non-empty text."""
    udf = F.pandas_udf(_spoken_udf, "array<string>")
    d = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0))
    return d.select(F.col(id_col).alias("doc"), F.posexplode(udf(F.col(text_col))).alias("reading", "words")).where("words <> ''")


def postings(spoken_words: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """(term, doc, reading, pos) of the terms in the vocabulary (distinct terms)."""
    words = spoken_words.select("doc", "reading", F.posexplode(F.split("words", " ")).alias("pos", "term"))
    return words.join(F.broadcast(vocabulary) if small else vocabulary, "term", "left_semi")


def anchors(tests: DataFrame, df: DataFrame, words: int, n: int) -> DataFrame:
    """(term, item, q): of each window of test words the n rarest positions by corpus
    frequency; a term the corpus lacks votes for nothing and is passed over, but then a
    window that lacks any of its words exactly still has its other terms."""
    t = tests.select("item", F.posexplode(F.split("words", "[ _]")).alias("q", "term"))
    freq = t.join(df, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("item").orderBy("q").rowsBetween(0, words - 1)
    ranked = freq.withColumn("win", F.collect_list(F.struct("n", "q", "term")).over(w)).where(F.size("win") == words)
    known = F.filter("win", lambda x: x["n"] > 0)
    return ranked.select("item", F.explode(F.slice(F.array_sort(known), 1, n)).alias("a")).select("a.term", "item", "a.q").distinct()


def _near(a: str, b: str) -> bool:
    """Equal, or one edit apart in words of four letters or more."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


class _Parsed(dict):
    """Words of a test item as (place of the first part, parts); forgets all when it holds too many."""

    def __missing__(self, test: str) -> list[tuple[int, list[str]]]:
        if len(self) >= 1 << 14:
            self.clear()
        out, q = [], 0
        for word in test.split(" "):
            parts = word.split("_")
            out.append((q, parts))
            q += len(parts)
        self[test] = out
        return out


_PARSED = _Parsed()


def longest_run(doc: list[str], test: str, offset: int, least: int) -> tuple[int, int]:
    """Most whole words of the test item in one run of agreeing parts on the diagonal, and
    the number of the first of them; (0, 0) if no run has `least` words. A run that long
    holds every least-th word, so only those are looked at until one agrees."""
    words, n = _PARSED[test], len(doc)

    def agrees(k: int) -> bool:
        q, parts = words[k]
        q += offset
        return 0 <= q and q + len(parts) <= n and all(_near(doc[q + i], p) for i, p in enumerate(parts))

    best, at, k = 0, 0, least - 1
    while k < len(words):
        if agrees(k):
            lo = hi = k
            while lo > 0 and agrees(lo - 1):
                lo -= 1
            while hi + 1 < len(words) and agrees(hi + 1):
                hi += 1
            if hi - lo + 1 >= max(least, best + 1):
                best, at = hi - lo + 1, lo
            k = hi
        k += least
    return best, at


def leaks(docs: DataFrame, tests: DataFrame, doc_id: str, text_col: str, item_id: str, item_text: str, words: int = 13, n_anchors: int = 5, votes: int = 2) -> DataFrame:
    """(doc, item, run, start): test items of which at least `words` consecutive words
    are spoken in a document, with the longest run and the word it starts with, from 0."""
    plain = F.pandas_udf(_plain_udf, "string")
    t = tests.where(F.col(item_id).isNotNull() & (F.length(item_text) > 0)).select(F.col(item_id).alias("item"), plain(F.col(item_text)).alias("words"))
    t = materialise(t.where(F.size(F.split("words", " ")) >= words).distinct(), "leak-tests")
    vocabulary = t.select(F.explode(F.split("words", "[ _]")).alias("term")).distinct()
    small = vocabulary.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    s = materialise(spoken_table(docs, doc_id, text_col), "leak-spoken")
    p = materialise(postings(s, vocabulary, small), "leak-postings")
    df = materialise(p.groupBy("term").agg(F.count("*").alias("n")), "leak-df")
    a = anchors(t, df, words, n_anchors)
    looked = F.broadcast(a) if a.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else a
    # intersect the offset-adjusted lists: an offset needs the votes of several anchors
    hits = p.join(looked, "term").groupBy("doc", "reading", "item", (F.col("pos") - F.col("q")).alias("offset")).agg(F.count("*").alias("v"))
    found = maybe_broadcast(materialise(hits.where(F.col("v") >= votes).drop("v"), "leak-found"))
    cols = s.join(found, ["doc", "reading"]).join(t.withColumnRenamed("words", "test"), "item").select("doc", "item", "offset", "words", "test")
    kind = dict(cols.dtypes)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            runs = [longest_run(d.split(" "), t, o, words) for d, t, o in zip(b.words, b.test, b.offset, strict=True)]
            out = b[["doc", "item"]].assign(run=[r for r, _ in runs], start=[s for _, s in runs])
            yield out[out.run >= words]

    runs = cols.mapInPandas(verify, f"doc {kind['doc']}, item {kind['item']}, run int, start int")
    return runs.groupBy("doc", "item").agg(F.max(F.struct("run", (-F.col("start")).alias("s"))).alias("m")).select("doc", "item", F.col("m.run").alias("run"), (-F.col("m.s")).alias("start"))
