"""Line search over guarded pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.dates import parse_since
from quillspark.sources import vault


def scope(pages: DataFrame, prefix: str | None = None) -> DataFrame:
    """Pages under a prefix; without one, all but raw/."""
    p = F.col("path")
    return pages.where(p.startswith(prefix) if prefix else ~p.startswith("raw/"))


def since(pages: DataFrame, text: str | None, now: datetime) -> DataFrame:
    """Pages changed since an interval (7d, 24h, 1w) or an ISO instant; an unreadable text
    keeps all, as does an unknown modification time."""
    if not text:
        return pages
    step = parse_since(text)
    try:
        at = now - step if step else datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return pages
    return pages.where(F.col("mtime").isNull() | (F.col("mtime") >= F.lit(at.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")))


def grep(pages: DataFrame, pattern: str, regex: bool = False) -> DataFrame:
    """(path, line_no, line) of matching lines. A fixed string is the default; a regular
    expression that does not compile finds nothing. Pages without a hit are dropped
    before their lines are split."""
    line = F.col("line")
    if not regex:
        return vault.lines(pages.where(F.contains("content", F.lit(pattern)))).where(F.contains(line, F.lit(pattern)))
    try:
        pages.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # a Java exception: the pattern is invalid
        return vault.lines(pages).where(F.lit(False))
    # a line's ends are line ends of the page then; what only a whole page can match (\A, \z) is not filtered
    whole = pages if r"\A" in pattern or r"\z" in pattern or r"\Z" in pattern else pages.where(F.col("content").rlike(f"(?m)(?:{pattern})"))
    return vault.lines(whole).where(line.rlike(pattern))


#: Most results of a search on the command line, in a chat, in the wiki and among life entries.
LIMITS = {"cli": 50, "chat": 20, "wiki": 10, "life": 20}


def first_hits(hits: DataFrame, most: int = LIMITS["cli"]) -> DataFrame:
    """The first lines found, by path and line."""
    return hits.orderBy("path", "line_no").limit(most)


def wiki(index: DataFrame, needle: str, most: int | None = None) -> DataFrame:
    """Index rows that hold the needle, in any case, in slug, summary or tags; with `most`,
    the first of them by slug."""
    hay = F.lower(F.concat_ws(" ", "slug", "summary", F.concat_ws(" ", "tags")))
    found = index.where(F.contains(hay, F.lit(needle.lower())))
    return found if most is None else found.orderBy(*(c for c in ("slug", "entry_id") if c in index.columns)).limit(most)
