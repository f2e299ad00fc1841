"""Visually identical text: a confusables skeleton per text, grouped by equality.

skeleton(text): decompose; drop invisible characters; replace every character by the
prototype of its look-alike class; decompose again. Two texts look the same iff their
skeletons are equal. Letters of one alphabet (I/l, O/0, rn/m), letter case, accents
and line ends are left apart.

Defined results: null text has a null skeleton and takes part in nothing; an empty
text, or one that is only invisible, has the empty skeleton and is no member of a
pair; repeated rows of one id count once; pure ASCII is its own skeleton. Other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters of other alphabets and the Latin letter (or digit) of the same shape.
CYRILLIC_SHAPES = {
    "А": "A", "В": "B", "Е": "E", "З": "3", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ԍ": "G",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ԍ": "g", "ү": "y",
}
GREEK_SHAPES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "α": "a", "ι": "i", "ρ": "p", "υ": "u",
    "γ": "y", "κ": "k", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "σ": "o",
}
OTHER_SHAPES = {
    "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "ս": "u", "հ": "h", "Տ": "S", "Օ": "O", "Ꭺ": "A", "Ꭼ": "E",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "’": "'", "‘": "'", "ʼ": "'", "′": "'", "∶": ":", "։": ":",
    "․": ".", "‚": ",", "⁄": "/", "∕": "/",
}
CHEROKEE_SHAPES = {
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮢ": "R", "Ꮤ": "W",
    "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K",
}
LISU_SHAPES = {
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S",
    "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
COPTIC_SHAPES = {
    "Ⲁ": "A", "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T",
    "Ⲩ": "Y", "Ⲭ": "X",
}
ARMENIAN_SHAPES = {
    "Ս": "U", "Լ": "L", "ց": "g", "զ": "q", "յ": "j",
}
#: Decompositions of these kinds keep the shape; others (superscripts, fractions) do not.
SAME_SHAPE = ("<wide>", "<narrow>", "<font>", "<noBreak>")


def _prototypes() -> dict[int, str]:
    """The look-alike table: fixed shapes, blanks, and by rule the code points whose
    compatibility decomposition keeps the shape."""
    table: dict[int, str] = {}
    for c in (*range(0x80, 0x30000), *range(0xE0000, 0xE0200)):
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat == "Cf" or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or c in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0):
            table[c] = ""
        elif cat == "Zs":
            table[c] = " "
        else:
            kind, _, rest = unicodedata.decomposition(ch).partition(" ")
            if kind in SAME_SHAPE:
                table[c] = "".join(chr(int(x, 16)) for x in rest.split())
    for shapes in (CYRILLIC_SHAPES, GREEK_SHAPES, CHEROKEE_SHAPES, LISU_SHAPES, COPTIC_SHAPES, ARMENIAN_SHAPES, OTHER_SHAPES):
        table.update({ord(k): v for k, v in shapes.items()})
    # forms such as full-width letters may lead to a character that has a prototype itself
    return {k: "".join(table.get(ord(x), x) for x in v) for k, v in table.items()}


#: Precomposed letters decompose first, so only these characters ever need replacing.
_TABLE = {chr(k): v for k, v in _prototypes().items()}


def confusables(spark: SparkSession) -> dict[str, str]:
    """The look-alike table widened by the public confusables data of Unicode, which come with
    the ICU library among Spark's jars: about 5,000 characters of all scripts. That data joins
    letters of one alphabet too (I, l and 1; O and 0; rn and m); a character gets instead the
    ASCII character of its class that has its own kind (upper case, lower case, digit). Latin
    letters up to U+024F, such as æ and ø, stay as they are, as do the table's own entries.
    Where the library is missing, the table without it is returned."""
    try:
        jvm = spark.sparkContext._jvm
        checker = jvm.com.ibm.icu.text.SpoofChecker
        made = checker.Builder().setChecks(checker.CONFUSABLE).build()
        ascii_chars = [chr(c) for c in range(0x21, 0x7F)]
        others = [ch for c in (*range(0x250, 0xD800), *range(0xF900, 0x20000)) if (ch := chr(c)) not in _TABLE and unicodedata.category(ch)[0] in "LNPSM" and unicodedata.normalize("NFD", ch) == ch]
        # one call: line ends part the characters, and no character's skeleton has one
        looks = made.getSkeleton("\n".join(ascii_chars + others)).split("\n")
    except Exception as e:  # a Java exception or a missing class
        raise RuntimeError("Unicode's confusables are not at hand: the ICU library (com.ibm.icu) is missing among Spark's jars or fails") from e
    if len(looks) != len(ascii_chars) + len(others):
        raise RuntimeError("the confusables table has an unexpected form")
    of_class: dict[str, list[str]] = {}
    for ch, look in zip(ascii_chars, looks, strict=False):
        of_class.setdefault(look, []).append(ch)
    kind = lambda ch: {"Lu": 0, "Lt": 0, "Nd": 2, "No": 2, "Nl": 2}.get(unicodedata.category(ch), 1 if unicodedata.category(ch)[0] == "L" else 3)
    table = {}
    for ch, look in zip(others, looks[len(ascii_chars) :], strict=True):
        same = sorted(of_class.get(look, [look]), key=lambda a: (len(a) == 1 and kind(a) != kind(ch), a))
        if ch not in "".join(_TABLE.get(x, x) for x in same[0]):
            table[ch] = same[0]
    table |= _TABLE

    def final(ch: str, seen: frozenset[str]) -> str:
        """What ch becomes once no part of it is replaced any more."""
        if ch not in table or ch in seen:
            return ch
        return "".join(final(x, seen | {ch}) for x in table[ch])

    return {ch: look for ch in table if (look := unicodedata.normalize("NFD", final(ch, frozenset()))) != ch}


def skeleton(text: str, table: dict[str, str] = _TABLE) -> str:
    if text.isascii():
        return text
    out = unicodedata.normalize("NFD", text)
    for ch in set(out) & table.keys():  # prototypes are never replaced again, so the order is free
        out = out.replace(ch, table[ch])
    return unicodedata.normalize("NFD", out)


def _skeletons(table: dict[str, str]):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else skeleton(t, table)).astype(object)

    return F.pandas_udf(run, "string")


def _keys(table: dict[str, str]):
    digest = lambda x: hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            look, exact, empty = [], [], []
            for t in s:
                k = skeleton(t, table)
                empty.append(not k)
                exact.append(e := digest(t))
                look.append(e if k is t or k == t else digest(k))
            yield pd.DataFrame({"look": look, "exact": exact, "blank": empty})

    return F.pandas_udf(run, "look binary, exact binary, blank boolean")


def normalized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with every text in its one consistent form; null stays null."""
    udf = _skeletons(confusables(docs.sparkSession))
    return docs.select(F.col(id_col), udf(F.col(text_col)).alias(text_col))


def look_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, look, exact): 128-bit digests of skeleton and text, of non-empty texts.
    Texts are hashed where they are read, so no text is ever shuffled."""
    udf = _keys(confusables(docs.sparkSession))
    d = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0))
    return d.select(F.col(id_col).alias("id"), udf(F.col(text_col)).alias("k")).select("id", "k.look", "k.exact", "k.blank").where("not blank").drop("blank")


def _variants(keys: DataFrame) -> DataFrame:
    """(look, exact) classes of the looks that at least two different texts share."""
    classes = keys.select("look", "exact").distinct()
    shared = classes.groupBy("look").count().where("count > 1").select("look")
    return classes.join(shared, "look")


def pairs(keys: DataFrame) -> DataFrame:
    """(a, b), a < b: ids whose texts look the same and differ. Pairs are formed between
    the different texts of a look first and only then expanded to their ids, so exact
    copies are never compared with each other."""
    v = _variants(keys)
    members = keys.join(v, ["look", "exact"], "left_semi").distinct()
    ways = v.select("look", F.col("exact").alias("exact_a")).join(v.select("look", F.col("exact").alias("exact_b")), "look").where("exact_a <> exact_b")
    a = members.select("look", F.col("exact").alias("exact_a"), F.col("id").alias("a"))
    b = members.select("look", F.col("exact").alias("exact_b"), F.col("id").alias("b"))
    return ways.join(a, ["look", "exact_a"]).join(b, ["look", "exact_b"]).where("a < b").select("a", "b").distinct()


def classes(keys: DataFrame) -> DataFrame:
    """(id, look_class, n_texts): every document with its class of equal looks."""
    k = keys.groupBy("look").agg(F.count_distinct("exact").alias("n_texts"))
    return keys.join(k, "look").select("id", F.hex("look").alias("look_class"), "n_texts")
