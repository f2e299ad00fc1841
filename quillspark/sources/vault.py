"""Page store as a table (path, content, mtime), always read through the guard.

The block list is applied inside the loader, before any user predicate, so no query can
reach a blocked path. Formats: whole-text files, frontmatter pages, and the line
encodings of index, life, drop, commit, memory and board pages."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Prefixes that no query may read, whatever the configuration adds.
ALWAYS_BLOCKED = ("life/credentials/",)
# The lines of index, life, memory and commit pages.
INDEX_RE = r"^- \[\[([a-z0-9-]+)\]\] — (.+?) \[(.*?)\](?: \((\d{4}-\d{2}-\d{2})\))?"
LIFE_RE = r"^## (\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}) — (.+)$"
MEMORY_RE = r"^(\S+)\s+(\S+\.md)\s+"
COMMIT_RE = r"^-\s*`([a-f0-9]+)`\s+\S+\s+\S+\s*\[[^\]]+\]\s*(.+)$"


def blocked(path: Column, prefixes: list[str] | None = None) -> Column:
    """Absolute, climbing or listed paths; null paths too."""
    out = path.startswith("/") | F.array_contains(F.split(path, "/"), "..")
    for p in sorted({*ALWAYS_BLOCKED, *(prefixes or [])}):
        out = out | path.startswith(p)
    return F.coalesce(out, F.lit(True))


def guarded(pages: DataFrame, prefixes: list[str] | None = None) -> DataFrame:
    return pages.where(~blocked(F.col("path"), prefixes))


def load(spark: SparkSession, root: str, prefixes: list[str] | None = None, glob: str = "*.{md,jsonl}") -> DataFrame:
    """Guarded pages of a folder: path relative to it, text, source modification time."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    base = root.rstrip("/") + "/"
    full = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    cut = F.substr(full, F.instr(full, base) + len(base))
    return guarded(raw.select(cut.alias("path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("mtime")), prefixes)


def attachments(spark: SparkSession, root: str, most_bytes: int = 20 * 1024 * 1024) -> DataFrame:
    """Binary files with text as text and the rest in base64. A file larger than `most_bytes`
    has its row too, with a null body, and is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    text = F.expr("is_valid_utf8(content)")
    b = files.where(F.col("length") <= most_bytes)
    read = b.select("path", "length", text.alias("is_text"), F.when(text, F.decode("content", "UTF-8")).otherwise(F.base64("content")).alias("body"))
    large = files.where(F.col("length") > most_bytes)
    return read.unionByName(large.select("path", "length", F.lit(None).cast("boolean").alias("is_text"), F.lit(None).cast("string").alias("body")))


def read_page(pages: DataFrame, path: str) -> DataFrame:
    """One row (content); '' for a missing page."""
    one = pages.where(F.col("path") == path).agg(F.max("content").alias("content"))
    return one.select(F.coalesce("content", F.lit("")).alias("content"))


def area(path: Column) -> Column:
    return F.split(path, "/")[0]


def page_slug(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")


def listing(pages: DataFrame, folder: str) -> DataFrame:
    """Markdown pages directly in a folder, without its index."""
    p = F.col("path")
    return pages.where(p.startswith(folder) & ~F.contains(F.substr(p, F.lit(len(folder) + 1)), F.lit("/")) & p.endswith(".md") & ~p.endswith("index.md"))


def frontmatter(content: Column) -> Column:
    """Struct (header, body): split at the first two lines of dashes; header null without."""
    rest = F.substr(content, F.lit(5))
    at = F.instr(rest, "---\n")
    has = content.startswith("---\n") & (at > 0)
    return F.when(has, F.struct(F.substr(rest, F.lit(1), at - 1).alias("header"), F.regexp_replace(F.substr(rest, at + 4), "^\n", "").alias("body"))).otherwise(
        F.struct(F.lit(None).cast("string").alias("header"), content.alias("body"))
    )


def header_value(header: Column, key: str) -> Column:
    """Scalar of a header line, unquoted; null if absent or empty."""
    return F.nullif(F.trim(F.regexp_extract(header, rf"(?m)^{key}:[ \t]*(.*)$", 1), F.lit(" \"'\r")), F.lit(""))


def header_list(header: Column, key: str) -> Column:
    """Inline list [a, b] of a header line; empty if absent."""
    inner = F.regexp_extract(header, rf"(?m)^{key}:[ \t]*\[(.*)\][ \t]*$", 1)
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x, F.lit(" \"'"))), lambda x: x != "")


def header_items(header: Column, key: str) -> Column:
    """List of a header key in either notation: inline [a, b], or one item per line after it."""
    block = F.regexp_extract(header, rf"(?m)^{key}:[ \t]*\r?\n((?:[ \t]*-[ \t]+[^\n]*(?:\n|\z))+)", 1)
    items = F.transform(F.split(block, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[ \t]*-[ \t]+", ""), F.lit(" \"'\r")))
    return F.when(block != "", F.filter(items, lambda x: x != "")).otherwise(header_list(header, key))


#: A parsed header: scalars as text, lists as JSON, nested keys joined by dots, and what was wrong.
HEADER = "struct<fields:map<string,string>,error:string>"


def _scalar(text: str) -> object:
    """Value of one header item: quoted or plain text, or an inline list or map of such."""
    t = text.strip()
    if t[:1] in "[{" and t[-1:] == {"[": "]", "{": "}"}.get(t[:1]):
        parts, depth, quote, start = [], 0, "", 1
        for i, ch in enumerate(t[1:-1], 1):
            if quote:
                quote = "" if ch == quote else quote
            elif ch in "\"'":
                quote = ch
            elif ch in "[{":
                depth += 1
            elif ch in "]}":
                depth -= 1
            elif ch == "," and depth == 0:
                parts.append(t[start:i])
                start = i + 1
        parts = [p for p in [*parts, t[start:-1]] if p.strip()]
        return [_scalar(p) for p in parts] if t[0] == "[" else {k.strip(): _scalar(v) for k, _, v in (p.partition(":") for p in parts)}
    if len(t) > 1 and t[0] == t[-1] and t[0] in "\"'":
        return t[1:-1]
    return re.sub(r"\s#.*$", "", t)


def parse_header(text: str | None) -> dict:
    """Fields of a page header in the part of YAML that pages use: scalars, lists in both
    notations and nested maps by indentation. A line that fits none is named in `error`, and
    what was read before and after it is kept."""
    fields: dict[str, object] = {}
    error, stack = None, [(-1, "")]
    for n, raw in enumerate((text or "").split("\n"), 1):
        line = raw.rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth = len(line) - len(line.lstrip())
        item = re.match(r"-\s+(.*)$|-$", line.strip())
        if item:
            key = stack[-1][1]
            if not key or not isinstance(fields.get(key, []), list):
                error = error or f"line {n}: an item of no list"
                continue
            fields.setdefault(key, []).append(_scalar(item[1] or ""))
            continue
        pair = re.match(r"([^\s:#\[\]{},][^:]*):(?:\s+(.*)|)$", line.strip())
        if not pair:
            error = error or f"line {n}: no key"
            continue
        while stack[-1][0] >= depth:
            stack.pop()
        key = f"{stack[-1][1]}.{pair[1].strip()}" if stack[-1][1] else pair[1].strip()
        if pair[2]:
            fields[key] = _scalar(pair[2])
        stack.append((depth, key))
    flat: dict[str, str] = {}
    for k, v in fields.items():
        if isinstance(v, dict):
            flat |= {f"{k}.{x}": y if isinstance(y, str) else json.dumps(y, ensure_ascii=False) for x, y in v.items()}
        else:
            flat[k] = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    return {"fields": flat, "error": error}


def header_fields(header: Column) -> Column:
    """All fields of a header, with the first error; no header has none."""

    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_header(t) for t in s], columns=["fields", "error"])

    return F.pandas_udf(run, HEADER)(header)


def lines(pages: DataFrame, content: str = "content", *keep: str) -> DataFrame:
    """One row per line, numbered from 1."""
    keep = keep or ("path",)
    return pages.select(*keep, F.posexplode(F.split(content, "\r?\n")).alias("at", "line")).withColumn("at", F.col("at") + 1).withColumnRenamed("at", "line_no")


def index_rows(numbered: DataFrame) -> DataFrame:
    """(path, line_no, slug, summary, tags, day) of index lines; the date may be missing."""
    g = lambda i: F.regexp_extract("line", INDEX_RE, i)
    tags = F.filter(F.transform(F.split(g(3), " "), lambda t: F.regexp_replace(t, "^#", "")), lambda t: t != "")
    return numbered.where(F.col("line").rlike(INDEX_RE)).select("path", "line_no", g(1).alias("slug"), g(2).alias("summary"), tags.alias("tags"), F.nullif(g(4), F.lit("")).alias("day"))


def life_entries(pages: DataFrame) -> DataFrame:
    """(path, n, ts, title, snippet): headed entries with the first line that is prose."""
    part = F.posexplode(F.split("content", "(?m)^(?=## )")).alias("n", "part")
    g = lambda i: F.regexp_extract("part", "(?m)" + LIFE_RE, i)
    body = F.filter(F.slice(F.split("part", "\n"), 2, 1 << 30), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("_"))
    e = pages.select("path", part).where(F.col("part").rlike("(?m)\\A" + LIFE_RE))
    return e.select("path", "n", F.concat(g(1), F.lit(" "), g(2)).alias("ts"), g(3).alias("title"), F.trim(F.try_element_at(body, F.lit(1))).alias("snippet"))


def carried(numbered: DataFrame, marker: str, name: str, key: str = "path") -> DataFrame:
    """Lines with the last heading that starts with `marker`, carried down; heading lines
    themselves and lines before the first heading are left out."""
    head = F.col("line").startswith(marker)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    value = F.last(F.when(head, F.trim(F.substr("line", F.lit(len(marker) + 1)))), ignorenulls=True).over(w)
    return numbered.withColumn(name, value).where(~head & F.col(name).isNotNull())
