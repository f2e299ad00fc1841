"""Filling fixed-capacity containers: first-fit decreasing over a tournament tree of
remaining room, run independently in randomised groups of documents.

Sizes are tokens of a public tokenizer. A document larger than a container is cut
into pieces of at most one container each; no other document is cut.

Defined results: null and empty texts get no container; ties in size are taken by
(id, piece); repeated ids are packed as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
#: Documents per randomised group; only the number of groups follows the data.
GROUP_DOCS = 8192
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary splits text into words before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict[str, object] = {}


def encoder(path: str = TOKENIZER):
    """The tokenizer of a rank file, loaded once per worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def cut(text: str, enc, capacity: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) pieces of a text that join to the whole; each piece encodes
    to at most `capacity` tokens on its own. The text is encoded once and cut between
    tokens that end a character; encoding a piece again only confirms its size."""
    raw = text.encode("utf-8", "surrogatepass")
    ends, at = [], 0
    for x in enc.decode_tokens_bytes(enc.encode_ordinary(text)):
        at += len(x)
        ends.append(at)
    out, first, byte, char = [], 0, 0, 0
    while byte < len(raw):
        last, piece, n = min(len(ends), first + capacity), "", 0
        while True:
            while last > first + 1 and ends[last - 1] < len(raw) and raw[ends[last - 1]] & 0xC0 == 0x80:
                last -= 1
            piece = raw[byte : ends[last - 1]].decode("utf-8", "surrogatepass")
            n = len(enc.encode_ordinary(piece))
            if n <= capacity or last == first + 1:
                break
            last -= max(1, n - capacity)
        out.append((char, char + len(piece), n))
        char, byte, first = char + len(piece), ends[last - 1], last
    return out


def sizes(docs: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, piece, start_char, end_char, n_tokens) of every non-empty document."""

    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(tokenizer)
        for s in batches:
            out = []
            for t in s:
                n = len(enc.encode_ordinary(t))
                parts = [(0, len(t), n)] if n <= capacity else cut(t, enc, capacity)
                out.append([{"start_char": a, "end_char": b, "n_tokens": k} for a, b, k in parts])
            yield pd.Series(out, dtype=object)

    udf = F.pandas_udf(measure, "array<struct<start_char:int,end_char:int,n_tokens:int>>")
    d = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), udf(F.col(text_col)).alias("parts"))
    return d.select("id", F.posexplode("parts").alias("piece", "p")).select("id", "piece", "p.start_char", "p.end_char", "p.n_tokens")


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """Bin number of each item; lengths must be in decreasing order. Leaves of the tree
    are bins, inner nodes the greater room of their two children; the leftmost bin with
    room is found by one descent."""
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins = []
    for x in lengths:
        if x > capacity:
            raise ValueError("an item is larger than a container")
        i = 1
        while i < leaves:
            i *= 2
            if room[i] < x:
                i += 1
        room[i] -= x
        bins.append(i - leaves)
        i //= 2
        while i:
            left, right = room[2 * i], room[2 * i + 1]
            room[i] = left if left > right else right
            i //= 2
    return bins


def containers(items: DataFrame, n_groups: int, capacity: int = CAPACITY, seed: int = 17) -> DataFrame:
    """Items (id, piece, ..., n_tokens) with their container (grp, bin)."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["n_tokens", "id", "piece"], ascending=[False, True, True], kind="stable")
        return g.assign(bin=first_fit_decreasing(g.n_tokens.tolist(), capacity))

    kind = ", ".join(f"{c} {t}" for c, t in items.dtypes)
    keyed = items.withColumn("grp", F.pmod(F.xxhash64("id", "piece", F.lit(seed)), F.lit(n_groups)).cast("int"))
    return keyed.groupBy("grp").applyInPandas(pack, f"{kind}, grp int, bin int")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, start_char, end_char, n_tokens, grp, bin): the containers of all
    non-empty documents. Only ids and sizes are shuffled, never texts."""
    n_groups = max(1, -(-docs.count() // GROUP_DOCS))
    return containers(sizes(docs, id_col, text_col, capacity, tokenizer), n_groups, capacity)
