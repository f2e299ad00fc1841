"""Operators over pages, index rows, boards and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.sources import vault

MAX_PEERS = 5


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Upsert by key: the row that is last in `order` (nulls first), chosen by a maximum
    that combines on the map side, so a hot key costs one row per task."""
    cols = [c for c in rows.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r"))
    return newest.select(key, *(F.col(f"r.{c}").alias(c) for c in cols))


def numbered_paths(rows: DataFrame, base: str, order: str, most: int = 9) -> DataFrame:
    """Path of each row for a base path that several rows want: the first gets it, the
    next -2 and so on up to `most`, later ones none. `order` is unique. Each task keeps only
    its first `most` of a base before the shuffle, so no base is sorted as a whole."""
    place = F.row_number().over(Window.partitionBy(base).orderBy(order))
    # a filter on the rank right above its window is applied on the map side as well
    first = rows.select(base, order).withColumn("n", place).where(F.col("n") <= most)
    stem = F.regexp_replace(base, r"\.md$", "")
    return rows.join(first, [base, order], "left").withColumn("path", F.when(F.col("n") == 1, F.col(base)).when(F.col("n") <= most, F.concat(stem, F.lit("-"), F.col("n").cast("string"), F.lit(".md"))))


def backlink(content: Column, slug: Column, marker: str = "## Related") -> Column:
    """Content with a link to `slug` at the end of its Related section, which is added if
    missing; unchanged if the page already links there."""
    link = F.concat(F.lit("- [["), slug, F.lit("]]"))
    lines = F.split(content, "\n")
    at = F.array_position(F.transform(lines, lambda x: F.trim(x)), F.lit(marker)).cast("int")
    tail = F.slice(lines, at + 1, F.size(lines))
    heads = F.transform(tail, lambda x: x.startswith("## "))
    stop = F.array_position(heads, F.lit(True)).cast("int")
    place = F.when(stop > 0, at + stop).otherwise(F.size(lines) + 1)
    inserted = F.array_join(F.array_insert(lines, place, link), "\n")
    added = F.concat(F.rtrim(content), F.lit(f"\n\n{marker}\n"), link, F.lit("\n"))
    return F.when(F.contains(content, F.concat(F.lit("[["), slug, F.lit("]]"))), content).when(at > 0, inserted).otherwise(added)


def board_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """(section, name, line): new lines replace those of the same name in any section,
    unmentioned lines stay."""
    kept = old.join(new.select("name"), "name", "left_anti").select("section", "name", "line")
    return kept.unionByName(new.select("section", "name", "line"))


def broken_links(pages: DataFrame) -> DataFrame:
    """(path, target): one row per link to a page that does not exist."""
    links = pages.select("path", F.explode(text.wikilinks(F.col("content"))).alias("target"))
    have = pages.select(vault.page_slug(F.col("path")).alias("target")).distinct()
    return links.join(have, "target", "left_anti").select("path", "target")


def orphan_pointers(pointers: DataFrame, pages: DataFrame) -> DataFrame:
    """(name, path) pointers to missing pages, and outside the wiki to empty ones too."""
    p = F.col("path")
    ok = pages.where(p.startswith("wiki/") | (F.length("content") > 0)).select("path").distinct()
    return pointers.select("name", "path").join(ok, "path", "left_anti").select("name", "path")


def tag_peers(queries: DataFrame, index: DataFrame, most: int = MAX_PEERS) -> DataFrame:
    """(slug, peer, overlap, place): pages that share most tags with each query page.
    Overlaps are counted per pair on the map side; the window holds one query's peers."""
    one = lambda d, name: d.select(F.col("slug").alias(name), F.explode(F.array_distinct("tags")).alias("tag"))
    hits = one(queries, "slug").join(one(index, "peer"), "tag").where("slug <> peer").groupBy("slug", "peer").agg(F.count("*").alias("overlap"))
    place = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("overlap"), "peer"))
    return hits.withColumn("place", place).where(F.col("place") <= most)


def link_commits(commits: DataFrame, projects: DataFrame) -> DataFrame:
    """(slug, sha): commits of a project, by its watched repositories; a project without
    any takes the lines that name it. Both rules are equi-joins, on the repository and on
    the words of the line, instead of a scan of every line for every project."""
    watched = projects.select("slug", F.explode("repos").alias("repo"))
    by_repo = commits.join(watched, "repo").select("slug", "sha", "key")
    words = commits.select("sha", "key", F.explode(F.array_distinct(F.split(F.lower("line"), "[^a-z0-9_-]+"))).alias("slug"))
    by_name = words.join(projects.where(F.size("repos") == 0).select("slug"), "slug").select("slug", "sha", "key")
    return by_repo.unionByName(by_name).distinct()


def regenerate_index(pages: DataFrame) -> DataFrame:
    """(path, line): index line of each page from its header and first prose line."""
    p = pages.withColumn("fm", vault.frontmatter(F.col("content")))
    slug = vault.page_slug(F.col("path"))
    summary = F.coalesce(text.first_prose_line(F.col("fm.body")), slug)
    day = F.coalesce(F.substring(vault.header_value(F.col("fm.header"), "created"), 1, 10), F.lit(""))
    return p.select("path", text.index_line(slug, summary, vault.header_list(F.col("fm.header"), "tags"), day).alias("line"))


def fill_days(counts: DataFrame, keys: DataFrame, key: str, last: Column, days: int = 30) -> DataFrame:
    """(key, day, n) with a row for every one of the last `days` days, zero where absent."""
    grid = keys.select(key, F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    return grid.join(counts, [key, "day"], "left").select(key, "day", F.coalesce("n", F.lit(0)).alias("n"))


def sparkline(points: Column, width: float = 70.0, height: float = 14.0) -> Column:
    """'x,y x,y ...' of a polyline scaled to the range of the points."""
    lo, hi = F.array_min(points), F.array_max(points)
    span, step = F.greatest(hi - lo, F.lit(1)), F.lit(width) / F.greatest(F.size(points) - 1, F.lit(1))
    one = lambda v, i: F.format_string("%.1f,%.1f", F.bround(i * step, 1), F.bround(F.lit(height - 1) - (v - lo) / span * F.lit(height - 2), 1))
    return F.concat_ws(" ", F.transform(points, one))


def fan_out(drops: DataFrame) -> DataFrame:
    """(record_seq, path, role): every page one classified drop writes to."""
    day = F.date_format("received_at", "yyyy-MM-dd")
    row = lambda p, r: F.struct(p.alias("path"), F.lit(r).alias("role"))
    has = F.length(F.coalesce("target_path", F.lit(""))) > 0
    known = has & F.col("target_kind").isin("project", "wiki")
    parts = F.array(
        F.when(has, row(F.col("target_path"), "page")),
        F.when(has & (F.col("target_kind") == "wiki"), row(F.lit("wiki/index.md"), "index")),
        row(F.concat(F.lit("daily/"), day, F.lit("/drops.md")), "log"),
        F.when(known, row(F.lit("MEMORY.md"), "pointer")),
        row(F.lit("log/decisions.md"), "decision"),
    )
    return drops.where("received_at is not null").select("record_seq", F.explode(F.array_compact(parts)).alias("w")).select("record_seq", "w.path", "w.role")


def replace_section(content: Column, heading: str, body: Column) -> Column:
    """Content with the lines of the section under `heading` replaced, up to the next H2;
    unchanged if there is no such section."""
    lines = F.split(content, "\n")
    at = F.array_position(lines, F.lit(heading)).cast("int")
    tail = F.slice(lines, at + 1, F.size(lines))
    stop = F.array_position(F.transform(tail, lambda x: x.startswith("## ")), F.lit(True)).cast("int")
    rest = F.when(stop > 0, F.slice(tail, F.greatest(stop, F.lit(1)), F.size(tail))).otherwise(F.array().cast("array<string>"))
    made = F.array_join(F.flatten(F.array(F.slice(lines, 1, at), F.array(body, F.lit("")), rest)), "\n")
    return F.when(at > 0, made).otherwise(content)


def move_page(pages: DataFrame, source: str, target: str, status: str) -> DataFrame:
    """(path, content): pages of one folder under another, with the first status line changed."""
    p = pages.where(F.col("path").startswith(source))
    path = F.concat(F.lit(target), F.substr("path", F.lit(len(source) + 1)))
    return p.select(path.alias("path"), text.first_replaced(F.col("content"), r"(?m)^status: .*$", f"status: {status}").alias("content"))


def with_context(drops: DataFrame, index: DataFrame) -> DataFrame:
    """Each drop with the newest index row of its page, if any (one row per drop)."""
    newest = latest(index.select("slug", "entry_id", "summary", "entry_date"), "slug", "entry_date", "entry_id")
    return drops.join(newest.select("slug", F.col("summary").alias("page_summary")), "slug", "left")


def with_pages(rows: DataFrame, store: DataFrame, **named: Column) -> DataFrame:
    """Each drop with the content of pages by name, '' where one is missing: a column per
    name whose value is a path, such as the target file, the memory page, the drops of the
    day, the decisions and the index. One row per path is taken, so drops never multiply;
    a page that all drops want (memory, decisions) is spread by a broadcast that is chosen
    at run time from its size."""
    one = store.groupBy("path").agg(F.max("content").alias("content"))
    for name, path in named.items():
        rows = rows.withColumn("_path", path).join(one.select(F.col("path").alias("_path"), F.col("content").alias(name)), "_path", "left").drop("_path")
        rows = rows.withColumn(name, F.coalesce(name, F.lit("")))
    return rows


def life_of_area(entries: DataFrame, pages_path: str, since: str, most: int = 20) -> DataFrame:
    """Entries (path, n, ts, title) of one area's page from `since` on, last in the file
    first. The area of credentials has none."""
    mine = entries.where((F.col("path") == pages_path) & (F.col("ts") >= since) & (F.col("path") != "life/credentials.md"))
    return mine.orderBy(F.desc("n")).limit(most)


def life_snapshots(entries: DataFrame, area: str, at: str, title: str, since: Column) -> DataFrame:
    """(area, n, titles): the titles of each area since an instant, in time order, one per
    line; areas without any have no row, nor has the one of credentials."""
    recent = entries.where((F.col(at) >= since) & (F.col(area) != "credentials"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, title))), lambda x: x[title]), "\n")
    return recent.groupBy(F.col(area).alias("area")).agg(F.count("*").alias("n"), listed.alias("titles"))


def critical(cards: DataFrame, most: int = 3) -> DataFrame:
    """Project cards with a blocker or an urgent deadline, the first few by slug."""
    c = cards.where((F.length("blocker") > 0) | (F.col("level") == "urgent"))
    return c.orderBy("slug").limit(most).select("slug", F.coalesce(F.nullif("blocker", F.lit("")), "note").alias("description"), F.when(F.col("level") != "ok", F.col("label")).otherwise("").alias("label"))


def project_groups(cards: DataFrame, most_archived: int = 5) -> DataFrame:
    """(path, grp): active, inactive, and the first archived pages as done."""
    gone = F.contains("path", F.lit("/archive/"))
    live = cards.where(~gone).select("path", F.when(F.coalesce(F.nullif("status", F.lit("")), F.lit("active")) == "active", "active").otherwise("inactive").alias("grp"))
    return live.unionByName(cards.where(gone).orderBy("path").limit(most_archived).select("path", F.lit("done").alias("grp")))
