"""Bindings of the page, search, link and evaluation operators.

The test data has no page store, so one is derived: wiki pages from index_entry, life
entries, credentials, raw and project pages from extraction, daily pages from documents,
and the seed files of eval_fixture. Each SQL derives the same store."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import evals, gate, mirror, pages, search
from quillspark.plans.scalar_queries import COMMITS_SQL, _commits, slug_sql
from quillspark.sources import vault
from quillspark.sources.tables import table
from quillspark.streaming import jobs

NOW = datetime(2024, 1, 31)


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


def _everything(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content, mtime) before the guard."""
    i = table(spark, sf, "index_entry")
    k = F.col("entry_id")
    conf = F.element_at(F.array(*map(F.lit, text.CONFIDENCE)), (k % 3 + 1).cast("int"))
    tags = F.concat_ws(", ", F.coalesce("tags", F.array().cast("array<string>")))
    head = F.concat(F.lit("---\nconfidence: "), conf, F.lit("\ntags: ["), tags, F.lit("]\ncreated: "), F.coalesce(_day("entry_date"), F.lit("")), F.lit("\n---\n"))
    page = F.concat(head, F.lit("# "), "slug", F.lit("\n\n"), F.coalesce("summary", F.lit("")), F.lit("\n\n## Related\n- [["), "slug", F.lit("-"), (k + k % 3).cast("string"), F.lit("]]\n"), F.when(k % 4 == 0, "\n## Notes\nkept\n").otherwise(""))
    wiki = i.select(F.concat(F.lit("wiki/"), "slug", F.lit("-"), k.cast("string"), F.lit(".md")).alias("path"), page.alias("content"), F.col("entry_date").cast("timestamp").alias("mtime"))

    e = table(spark, sf, "extraction").withColumn("x", F.col("extraction_id").cast("string"))
    title, body = F.coalesce("title", F.lit("untitled")), F.coalesce("content", F.lit(""))
    path = (
        F.when(F.col("kind") == "life_entry", F.concat(F.lit("life/entry-"), "x", F.lit(".md")))
        .when(F.col("kind") == "credential_entry", F.concat(F.lit("life/credentials/"), text.slugify(title), F.lit("-"), "x", F.lit(".md")))
        .when(F.col("kind") == "project_update", F.concat(F.lit("projects/"), text.slugify(title), F.lit("-"), "x", F.lit(".md")))
        .when(F.col("kind") == "concept_drop", F.concat(F.lit("raw/"), text.slugify(title), F.lit("-"), "x", F.lit(".md")))
    )
    content = (
        F.when(F.col("kind") == "life_entry", F.concat(F.lit("## "), F.date_format("extracted_at", "yyyy-MM-dd HH:mm"), F.lit(" — "), title, F.lit("\n\n_Context_\n"), body, F.lit("\n")))
        .when(F.col("kind") == "credential_entry", body)
        .otherwise(F.coalesce("summary", F.lit("")))
    )
    ext = e.where(path.isNotNull()).select(path.alias("path"), content.alias("content"), F.col("extracted_at").alias("mtime"))

    d = table(spark, sf, "documents").where("text is not null")
    daily = d.select(F.concat(F.lit("daily/"), F.coalesce(_day("uploaded_at"), F.lit("none")), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"), F.col("uploaded_at").alias("mtime"))

    f = table(spark, sf, "eval_fixture").select("id", F.explode("input.seed_files").alias("p", "c"))
    seeds = f.select(F.concat(F.lit("seed/"), "id", F.lit("/"), "p").alias("path"), F.col("c").alias("content"), F.lit(None).cast("timestamp").alias("mtime"))
    return wiki.unionByName(ext).unionByName(daily).unionByName(seeds).where("path is not null")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return vault.guarded(_everything(spark, sf))


def _wiki(spark: SparkSession, sf: str) -> DataFrame:
    return vault.listing(_pages(spark, sf), "wiki/")


def guarded_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("path", F.length("content").alias("chars"))


def frontmatter_split(spark: SparkSession, sf: str) -> DataFrame:
    p = _wiki(spark, sf).withColumn("fm", vault.frontmatter(F.col("content")))
    return p.select("path", vault.header_value(F.col("fm.header"), "confidence").alias("confidence"), F.concat_ws("|", vault.header_list(F.col("fm.header"), "tags")).alias("tags"), F.md5("fm.body").alias("body"))


def _index_lines(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "index_entry").where("summary is not null")
    line = text.index_line(F.col("slug"), F.col("summary"), F.col("tags"), F.coalesce(_day("entry_date"), F.lit("")))
    return i.select(F.lit("wiki/index.md").alias("path"), F.col("entry_id").alias("line_no"), line.alias("line"))


def wiki_index_parse(spark: SparkSession, sf: str) -> DataFrame:
    r = vault.index_rows(_index_lines(spark, sf))
    return r.select("line_no", "slug", "summary", F.concat_ws("|", "tags").alias("tags"), F.coalesce("day", F.lit("")).alias("day"))


def life_entries_since(spark: SparkSession, sf: str) -> DataFrame:
    e = vault.life_entries(_pages(spark, sf).where(F.col("path").startswith("life/")))
    return e.where("ts >= '2024-01-01 00:00'").select("path", "ts", "title", F.coalesce("snippet", F.lit("")).alias("snippet"))


def life_recent_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = vault.life_entries(_pages(spark, sf).where(F.col("path").startswith("life/")))
    return e.orderBy(F.desc("ts"), "path").limit(20).select("path", "ts", "title")


def _drop_pages(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "pipeline_record").where("received_at is not null")
    e = text.drop_entry(F.date_format("received_at", "HH:mm"), F.coalesce("target_kind", F.lit("")), F.col("drop_type"), F.col("target_path"), F.col("slug"))
    return t.select("record_seq", e.alias("content"))


def drop_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(time, kind, destination) by pairing each heading with the line after it; redacted
    credentials have no destination and drop out."""
    n = vault.lines(_drop_pages(spark, sf), "content", "record_seq")
    w = Window.partitionBy("record_seq").orderBy("line_no")
    p = n.withColumn("next", F.lead("line").over(w)).where(F.col("line").rlike(r"^## \d{2}:\d{2}\s*$"))
    dest = r"^\*\*(\S+)\*\* → `([^`]+)`"
    return p.where(F.col("next").rlike(dest)).select("record_seq", F.substring("line", 4, 5).alias("time"), F.regexp_extract("next", dest, 1).alias("kind"), F.regexp_extract("next", dest, 2).alias("destination"))


def _commit_page_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered lines of one commit page per day: a heading per repository, then its commits."""
    c = _commits(spark, sf)
    line = F.concat(F.lit("- `"), "sha", F.lit("` "), "day", F.lit(" 00:00 [bot] "), "message")
    body = c.select("day", "repo", F.col("o_orderkey").alias("k"), line.alias("line"))
    heads = c.select("day", "repo").distinct().select("day", "repo", F.lit(-1).cast("long").alias("k"), F.concat(F.lit("### "), "repo").alias("line"))
    n = F.row_number().over(Window.partitionBy("day").orderBy("repo", "k"))
    return body.unionByName(heads).select(F.concat(F.lit("daily/"), "day", F.lit("/commits.md")).alias("path"), "day", n.alias("line_no"), "line")


def commit_lines_ffill(spark: SparkSession, sf: str) -> DataFrame:
    c = vault.carried(_commit_page_lines(spark, sf), "### ", "repo")
    g = lambda i: F.regexp_extract("line", vault.COMMIT_RE, i)
    return c.where(F.col("line").rlike(vault.COMMIT_RE)).select("path", g(1).alias("sha"), F.substring(F.trim(g(2)), 1, 80).alias("message"), "repo")


def section_parse(spark: SparkSession, sf: str) -> DataFrame:
    c = vault.carried(_commit_page_lines(spark, sf), "### ", "section")
    return c.groupBy("path", "section").agg(F.count("*").alias("n_lines"), F.min("line").alias("first_line"))


def queue_claimable_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Queue files without a sidecar that marks them as being processed."""
    e = table(spark, sf, "events")
    name = F.concat(F.lit("queue-"), F.col("event_id").cast("string"), F.lit("-"), "event_type", F.lit(".md"))
    names = e.select(name.alias("name")).unionAll(e.where("event_id % 5 = 0").select(F.concat(name, F.lit(".processing"))))
    files = names.where(F.col("name").rlike(r"^queue-\d+-\w+\.md$"))
    claimed = names.where(F.col("name").endswith(".processing")).select(F.regexp_replace("name", r"\.processing$", "").alias("name"))
    return files.join(claimed, "name", "left_anti")


def raw_path_collisions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "extraction").where("title is not null").withColumn("base", F.concat(F.lit("raw/"), _day("extracted_at"), F.lit("-web-"), text.slugify(F.col("title")), F.lit(".md")))
    return pages.numbered_paths(e, "base", "extraction_id").select("extraction_id", F.coalesce("path", F.lit("")).alias("path"))


def writer_fanout(spark: SparkSession, sf: str) -> DataFrame:
    return pages.fan_out(table(spark, sf, "pipeline_record"))


def index_upsert(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "index_entry").select("slug", "entry_id", "summary", "entry_date")
    return pages.latest(i, "slug", "entry_date", "entry_id").select("slug", "entry_id", "summary")


def backlink_insert(spark: SparkSession, sf: str) -> DataFrame:
    return _wiki(spark, sf).select("path", F.md5(pages.backlink(F.col("content"), F.lit("new-page"))).alias("digest"))


_SECTIONS = ("Active", "Inactive", "Done")


def board_merge(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    pick = lambda k: F.element_at(F.array(*map(F.lit, _SECTIONS)), (k % 3 + 1).cast("int"))
    line = lambda s: F.concat(F.lit("- ["), "c_name", F.lit("] — "), F.lit(s))
    old = c.select(pick(F.col("c_custkey")).alias("section"), F.col("c_name").alias("name"), line("old").alias("line"))
    new = c.where("c_custkey % 2 = 0").select(pick(F.col("c_custkey") % 5).alias("section"), F.col("c_name").alias("name"), line("new").alias("line"))
    return pages.board_merge(old, new)


def archival_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Daily pages older than 67 days with their archive path."""
    p = _pages(spark, sf).where(F.col("path").startswith("daily/"))
    day = F.split("path", "/")[1].try_cast("date")
    return p.where(day < F.date_sub(F.lit("2024-01-31").cast("date"), 67)).select("path", F.concat(F.lit("archive/"), "path").alias("new_path"))


def mirror_upsert(spark: SparkSession, sf: str) -> DataFrame:
    s, b = _mirror(spark, sf)
    return mirror.upsert(s, b)


def _mirror(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf, "part").withColumn("path", F.concat(F.lit("parts/"), F.col("p_partkey").cast("string"), F.lit(".md")))
    return p.where("p_partkey % 3 <> 0").select("path", F.col("p_name").alias("content")), p.where("p_partkey % 50 <> 1").select("path", F.col("p_brand").alias("content"))


def mirror_verify(spark: SparkSession, sf: str) -> DataFrame:
    return mirror.verify(*_mirror(spark, sf), "parts/2.md")


def harvest_fresh_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Runs whose drop has not been harvested yet."""
    return evals.fresh(table(spark, sf, "pipeline_record").where("drop_id is not null").select("record_seq", "drop_id"), table(spark, sf, "harvested_fixture").select(F.col("source_drop_id").alias("drop_id")), "drop_id")


def accept_semi(spark: SparkSession, sf: str) -> DataFrame:
    pending = table(spark, sf, "harvested_fixture").where("source_harvest_id >= '2024-01-15'").select("id")
    return evals.accept(pending, table(spark, sf, "harvested_fixture").select("id", "category", "fixture_no"), "id")


def rollback_filter(spark: SparkSession, sf: str) -> DataFrame:
    return evals.rollback(table(spark, sf, "harvested_fixture"), "source_harvest_id", "2024-01-10").select("fixture_no", "source_harvest_id")


def search_scope(spark: SparkSession, sf: str) -> DataFrame:
    return search.scope(_pages(spark, sf)).select("path")


def since_filter(spark: SparkSession, sf: str) -> DataFrame:
    return search.since(_pages(spark, sf), "7d", NOW).select("path")


def grep_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return search.grep(search.scope(_pages(spark, sf)), "lighthouse")


def grep_regex(spark: SparkSession, sf: str) -> DataFrame:
    return search.grep(search.scope(_pages(spark, sf), "daily/"), "(old|blue) (well|lantern)", regex=True)


def search_wiki(spark: SparkSession, sf: str) -> DataFrame:
    return search.wiki(table(spark, sf, "index_entry"), "Cedar").select("entry_id", "slug")


def pending_live(spark: SparkSession, sf: str) -> DataFrame:
    """Pending calls that neither expired (300 s) nor were taken at the clock. Calls come about
    once in four minutes, so each is taken to have come a 60th of its time before the clock."""
    clock = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    e = table(spark, sf, "events").withColumn("at", clock - F.make_dt_interval(secs=(F.abs(F.unix_micros(clock.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 60e6).cast("decimal(18,6)")))
    return gate.live(e, "at", clock, 300, F.col("event_id") % 4 == 0).select("event_id", "user_id")


def cooldown_accepts(spark: SparkSession, sf: str) -> DataFrame:
    return gate.cooldown(table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 3600.0)


def broken_wikilinks(spark: SparkSession, sf: str) -> DataFrame:
    return pages.broken_links(_wiki(spark, sf))


def orphan_pointers(spark: SparkSession, sf: str) -> DataFrame:
    lines = _pointer_lines(spark, sf)
    g = lambda i: F.regexp_extract("line", vault.MEMORY_RE, i)
    return pages.orphan_pointers(lines.select(g(1).alias("name"), g(2).alias("path")), _pages(spark, sf))


def _pointer_lines(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "index_entry")
    path = F.concat(F.lit("wiki/"), "slug", F.lit("-"), (F.col("entry_id") + F.col("entry_id") % 2).cast("string"), F.lit(".md"))
    return i.select(text.memory_line(path, F.coalesce("summary", F.lit("")), F.lit("high")).alias("line"))


def _tagged(spark: SparkSession, sf: str) -> DataFrame:
    """(slug, entry_id, tags): the newest tagged entry of each page."""
    i = table(spark, sf, "index_entry").where("size(tags) > 0").select("slug", "entry_id", "tags", "entry_date")
    return pages.latest(i, "slug", "entry_date", "entry_id").select("slug", "entry_id", "tags")


def tag_peers_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Query pages are those whose newest entry number is divisible by 100, against all: a
    sample, of one page at scale 0.1. tag_peers_all is the whole job."""
    newest = _tagged(spark, sf)
    return pages.tag_peers(newest.where("entry_id % 100 = 0"), newest)


def tag_peers_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every page against all others."""
    newest = _tagged(spark, sf)
    return pages.tag_peers(newest, newest)


def commits_for_project(spark: SparkSession, sf: str) -> DataFrame:
    """Every third nation watches a repository; the others are found by name."""
    c = _commits(spark, sf).withColumn("line", F.concat(F.lit("- `"), "sha", F.lit("` "), "message", F.lit(" nation_"), (F.col("o_orderkey") % 25).cast("string")))
    n = table(spark, sf, "nation")
    seg = F.element_at(F.array(*map(F.lit, ("automobile", "building", "furniture", "household", "machinery"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    p = n.select(F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("slug"), F.when(F.col("n_nationkey") % 3 == 0, F.array(seg)).otherwise(F.array().cast("array<string>")).alias("repos"))
    return pages.link_commits(c.select("sha", F.col("o_orderkey").alias("key"), "repo", "line"), p).select("slug", F.col("key").alias("o_orderkey"), "sha")


def mentions_per_day(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "pipeline_record").where("slug is not null and received_at is not null").select("slug", F.to_date("received_at").alias("day"))
    counts = t.groupBy("slug", "day").agg(F.count("*").alias("n"))
    f = pages.fill_days(counts, t.select("slug").distinct(), "slug", F.lit("2024-01-30").cast("date"))
    return f.select("slug", _day("day").alias("day"), "n")


def sparkline_points(spark: SparkSession, sf: str) -> DataFrame:
    m = mentions_per_day(spark, sf).groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("p"))  # 30 rows a slug
    return m.select("slug", pages.sparkline(F.col("p.n").cast("array<double>")).alias("points"))


def mention_totals(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", text.occurrences(F.lower("text"), F.lit("the mayor")).alias("n"))


def _cassettes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "classification").select("classification_id", "target_kind", "slug", "confidence", "life_area").distinct()
    key = F.substring(F.sha2(F.col("classification_id").cast("string"), 256), 1, 16)
    agent = F.element_at(F.array(F.lit("classifier"), F.lit("extractor"), F.lit("verifier")), (F.col("classification_id") % 3 + 1).cast("int"))
    c = c.select("classification_id", agent.alias("agent"), key.alias("prompt_hash"), "target_kind", "slug", "confidence", "life_area")
    new = c.where("classification_id % 10 <> 0").withColumn("confidence", F.when(F.col("classification_id") % 7 == 0, "low").otherwise(F.col("confidence")))
    return c.where("classification_id % 10 <> 9"), new


def _response(d: DataFrame) -> DataFrame:
    return d.withColumn("response", F.concat_ws("/", "target_kind", "slug", "confidence"))


def drift_diff(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _cassettes(spark, sf)
    return evals.drift(_response(old), _response(new), "agent", "prompt_hash")


def ablation_divergence(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _cassettes(spark, sf)
    return evals.ablation(old, new, "prompt_hash", ["target_kind", "slug", "confidence"])


def cassette_replay(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _cassettes(spark, sf)
    return evals.replay(new.select("classification_id", "prompt_hash"), _response(old), "prompt_hash").select("classification_id", "hit", F.coalesce("response", F.lit("")).alias("response"))


def cassette_usage(spark: SparkSession, sf: str) -> DataFrame:
    old, _ = _cassettes(spark, sf)
    latency = F.when(F.col("classification_id") % 4 != 0, (F.col("classification_id") % 900).cast("double"))
    return evals.usage(old.withColumn("tokens", F.length(F.coalesce("slug", F.lit("")))).withColumn("latency_ms", latency))


def json_deep_diff(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _cassettes(spark, sf)
    doc = lambda d: d.select("classification_id", F.from_json(F.to_json(F.struct("target_kind", "slug", "confidence", "life_area")), "map<string,string>").alias("fields"))
    return evals.deep_diff(doc(old), doc(new), "classification_id")


def lookup_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Content of a project page, else of its archived copy, else ''."""
    p = table(spark, sf, "part")
    live = p.where("p_partkey % 2 = 0").select("p_partkey", F.col("p_name").alias("a"))
    archive = p.where("p_partkey % 3 = 0").select("p_partkey", F.col("p_brand").alias("b"))
    j = p.select("p_partkey").join(live, "p_partkey", "left").join(archive, "p_partkey", "left")
    return j.select("p_partkey", F.coalesce("a", "b", F.lit("")).alias("content"))


def tag_cloud(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "index_entry").select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return t.orderBy(F.desc("n"), "tag").limit(12)


def commit_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Commits by repository and type with the totals of each repository."""
    c = _commits(spark, sf)
    g = c.rollup("repo", "type").agg(F.count("*").alias("n"), F.count_if("breaking").alias("n_breaking"), F.grouping_id().alias("level"))
    return g.where("level < 3").select("repo", F.coalesce("type", F.lit("all")).alias("type"), "n", "n_breaking")


def onboarding_distinct(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "harvested_fixture").groupBy(F.col("expected.target_kind").alias("target_kind"))
    return h.agg(F.count_distinct("source_harvest_id").alias("harvests")).withColumn("onboarded", F.col("harvests") >= 3)


def lint_summary(spark: SparkSession, sf: str) -> DataFrame:
    w = _wiki(spark, sf)
    broken = pages.broken_links(w).agg(F.count("*").alias("n")).select(F.lit("broken_links").alias("check"), "n")
    fm = w.select(vault.frontmatter(F.col("content")).alias("fm"), "mtime")
    stale = (vault.header_value(F.col("fm.header"), "confidence") == "high") & (F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("mtime")) > 30)
    demoted = fm.agg(F.count_if(stale).alias("n")).select(F.lit("demoted").alias("check"), "n")
    orphans = orphan_pointers(spark, sf).agg(F.count("*").alias("n")).select(F.lit("orphan_pointers").alias("check"), "n")
    return broken.unionByName(demoted).unionByName(orphans)


def weekly_context(spark: SparkSession, sf: str) -> DataFrame:
    """The last seven days as one text per day, each cut to 1,500 characters."""
    t = table(spark, sf, "pipeline_record").where(F.col("received_at").between(F.lit("2024-01-22").cast("timestamp"), F.lit("2024-01-29").cast("timestamp")))
    d = t.groupBy(_day("received_at").alias("day"), F.col("drop_type")).agg(F.count("*").alias("n"))
    rows = d.groupBy("day").agg(F.array_sort(F.collect_list(F.concat(F.coalesce("drop_type", F.lit("")), F.lit(": "), F.col("n").cast("string")))).alias("r"))
    return rows.select("day", F.substring(F.concat_ws("\n", "r"), 1, 1500).alias("context"))


def index_regenerate(spark: SparkSession, sf: str) -> DataFrame:
    return pages.regenerate_index(_wiki(spark, sf))


def escalation_two_pass(spark: SparkSession, sf: str) -> DataFrame:
    """Runs that escalate go through a second pass; the others keep the first result."""
    t = table(spark, sf, "pipeline_record").select("record_seq", F.coalesce("escalated", F.lit(False)).alias("e"), "target_confidence", F.coalesce("verifier_ok", F.lit(False)).alias("ok"))
    first = lambda d: d.withColumn("escalated", F.col("e")).withColumn("passes", F.lit(1))
    second = lambda d: d.withColumn("passes", F.lit(2)).withColumn("target_confidence", F.when(F.col("ok"), F.col("target_confidence")).otherwise("blocked"))
    return jobs.two_pass(first, second)(t).select("record_seq", "passes", "target_confidence")


QUERIES = {
    f.__name__: f
    for f in (
        guarded_scan, frontmatter_split, wiki_index_parse, life_entries_since, life_recent_topk, drop_lines,
        commit_lines_ffill, section_parse, queue_claimable_anti, raw_path_collisions, writer_fanout, index_upsert, backlink_insert,
        board_merge, archival_sweep, mirror_upsert, mirror_verify, harvest_fresh_anti, accept_semi, rollback_filter, search_scope,
        since_filter, grep_fixed, grep_regex, search_wiki, pending_live, cooldown_accepts, broken_wikilinks,
        orphan_pointers, tag_peers_topk, tag_peers_all, commits_for_project, mentions_per_day, sparkline_points, mention_totals, drift_diff,
        ablation_divergence, cassette_replay, cassette_usage, json_deep_diff, lookup_with_fallback, tag_cloud, commit_digest,
        onboarding_distinct, lint_summary, weekly_context, index_regenerate, escalation_two_pass,
    )
}

_NL = "chr(10)"
_CONF = "['high', 'medium', 'low'][CAST(entry_id % 3 + 1 AS INT)]"
_D = lambda c: f"strftime({c} AT TIME ZONE 'UTC', '%Y-%m-%d')"
_WIKI_BODY = f"""'# ' || slug || {_NL} || {_NL} || coalesce(summary, '') || {_NL} || {_NL} || '## Related' || {_NL} || '- [[' || slug || '-' || (entry_id + entry_id % 3) || ']]' || {_NL}
 || CASE WHEN entry_id % 4 = 0 THEN {_NL} || '## Notes' || {_NL} || 'kept' || {_NL} ELSE '' END"""
_TAGS = "array_to_string(coalesce(tags, []), ', ')"
_CREATED = "coalesce(strftime(entry_date, '%Y-%m-%d'), '')"
_PAGE = f"'---' || {_NL} || 'confidence: ' || {_CONF} || {_NL} || 'tags: [' || {_TAGS} || ']' || {_NL} || 'created: ' || {_CREATED} || {_NL} || '---' || {_NL} || {_WIKI_BODY}"
_T = "coalesce(title, 'untitled')"
_V = f"""WITH everything AS (
SELECT 'wiki/' || slug || '-' || entry_id || '.md' AS path, {_PAGE} AS content, CAST(entry_date AS TIMESTAMP) AS mtime FROM index_entry
UNION ALL SELECT CASE kind WHEN 'life_entry' THEN 'life/entry-' || extraction_id || '.md' WHEN 'credential_entry' THEN 'life/credentials/' || {slug_sql(_T)} || '-' || extraction_id || '.md'
 WHEN 'project_update' THEN 'projects/' || {slug_sql(_T)} || '-' || extraction_id || '.md' ELSE 'raw/' || {slug_sql(_T)} || '-' || extraction_id || '.md' END,
 CASE kind WHEN 'life_entry' THEN '## ' || strftime(extracted_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') || ' — ' || {_T} || {_NL} || {_NL} || '_Context_' || {_NL} || coalesce(content, '') || {_NL}
 WHEN 'credential_entry' THEN coalesce(content, '') ELSE coalesce(summary, '') END, extracted_at AT TIME ZONE 'UTC' FROM extraction WHERE kind IN ('life_entry', 'credential_entry', 'project_update', 'concept_drop')
UNION ALL SELECT 'daily/' || coalesce({_D('uploaded_at')}, 'none') || '/doc-' || doc_id || '.md', text, uploaded_at AT TIME ZONE 'UTC' FROM documents WHERE text IS NOT NULL
UNION ALL SELECT 'seed/' || id || '/' || e.key, e.value, NULL FROM (SELECT id, unnest(map_entries(input.seed_files)) AS e FROM eval_fixture)),
v AS (SELECT * FROM everything WHERE path IS NOT NULL AND NOT starts_with(path, 'life/credentials/')),
wiki AS (SELECT * FROM v WHERE starts_with(path, 'wiki/'))"""
_LINES = "ln AS (SELECT path, unnest(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10))) AS line, unnest(range(1, len(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10))) + 1)) AS line_no FROM v)"
_LIFE = f"""lf AS (SELECT 'life/entry-' || extraction_id || '.md' AS path, extraction_id, strftime(extracted_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS ts, {_T} AS title,
 list_filter(list_transform(string_split(coalesce(content, ''), {_NL}), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '_')) AS body, extracted_at
 FROM extraction WHERE kind = 'life_entry' AND extracted_at IS NOT NULL AND {_T} <> '' AND NOT contains({_T}, chr(10)))"""
_CASS = """c AS (SELECT DISTINCT classification_id, ['classifier', 'extractor', 'verifier'][CAST(classification_id % 3 + 1 AS INT)] AS agent,
 substr(sha256(CAST(classification_id AS VARCHAR)), 1, 16) AS prompt_hash, target_kind, slug, confidence, life_area FROM classification),
o AS (SELECT *, concat_ws('/', target_kind, slug, confidence) AS response FROM c WHERE classification_id % 10 <> 9),
n0 AS (SELECT * REPLACE (CASE WHEN classification_id % 7 = 0 THEN 'low' ELSE confidence END AS confidence) FROM c WHERE classification_id % 10 <> 0),
n AS (SELECT *, concat_ws('/', target_kind, slug, confidence) AS response FROM n0)"""
_MIRROR = """s AS (SELECT 'parts/' || p_partkey || '.md' AS path, p_name AS content FROM part WHERE p_partkey % 3 <> 0),
b AS (SELECT 'parts/' || p_partkey || '.md' AS path, p_brand AS content FROM part WHERE p_partkey % 50 <> 1)"""
_MENTIONS = """t AS (SELECT slug, CAST(received_at AT TIME ZONE 'UTC' AS DATE) AS day FROM pipeline_record WHERE slug IS NOT NULL AND received_at IS NOT NULL),
g AS (SELECT slug, unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT slug FROM t)),
m AS (SELECT g.slug, strftime(g.day, '%Y-%m-%d') AS day, count(t.slug) AS n FROM g LEFT JOIN t ON t.slug = g.slug AND t.day = g.day GROUP BY g.slug, g.day)"""
_BROKEN = f"""bl AS (SELECT path, unnest(regexp_extract_all(content, '\\[\\[([a-z0-9-]+)\\]\\]', 1)) AS target FROM wiki),
br AS (SELECT * FROM bl WHERE target NOT IN (SELECT replace(replace(path, 'wiki/', ''), '.md', '') FROM wiki))"""
_ORPH = """op AS (SELECT slug || '-' || (entry_id + entry_id % 2) AS name, 'wiki/' || slug || '-' || (entry_id + entry_id % 2) || '.md' AS path FROM index_entry),
orph AS (SELECT * FROM op WHERE path NOT IN (SELECT path FROM wiki))"""

SQL = {
    "guarded_scan": f"{_V} SELECT path, CAST(length(content) AS INT) AS chars FROM v",
    "frontmatter_split": f"""SELECT 'wiki/' || slug || '-' || entry_id || '.md' AS path, {_CONF} AS confidence,
 array_to_string(list_filter(list_transform(coalesce(tags, []), lambda t: trim(t, ' "'''))  , lambda t: t <> ''), '|') AS tags, md5({_WIKI_BODY}) AS body FROM index_entry""",
    "wiki_index_parse": """SELECT entry_id AS line_no, slug, trim(replace(substr(coalesce(nullif(summary, ''), slug), 1, 60), chr(10), ' ')) AS summary,
 array_to_string(list_transform(list_filter(string_split(array_to_string(list_transform(list_slice(coalesce(tags, []), 1, 5), lambda t: '#' || t), ' '), ' '), lambda t: regexp_replace(t, '^#', '') <> ''), lambda t: regexp_replace(t, '^#', '')), '|') AS tags,
 coalesce(strftime(entry_date, '%Y-%m-%d'), '') AS day FROM index_entry WHERE summary IS NOT NULL""",
    "life_entries_since": f"WITH {_LIFE} SELECT path, ts, title, coalesce(list_extract(body, 1), '') AS snippet FROM lf WHERE ts >= '2024-01-01 00:00'",
    "life_recent_topk": f"WITH {_LIFE} SELECT path, ts, title FROM lf ORDER BY ts DESC, path LIMIT 20",
    "drop_lines": """SELECT record_seq, strftime(received_at AT TIME ZONE 'UTC', '%H:%M') AS time, drop_type AS kind, coalesce(nullif(target_path, ''), 'daily_only') AS destination
 FROM pipeline_record WHERE received_at IS NOT NULL AND coalesce(target_kind, '') <> 'credential' AND drop_type IS NOT NULL""",
    "commit_lines_ffill": f"WITH {COMMITS_SQL} SELECT 'daily/' || day || '/commits.md' AS path, sha, substr(trim(message), 1, 80) AS message, repo FROM c",
    "section_parse": f"""WITH {COMMITS_SQL} SELECT 'daily/' || day || '/commits.md' AS path, repo AS section, count(*) AS n_lines,
 min('- `' || sha || '` ' || day || ' 00:00 [bot] ' || message) AS first_line FROM c GROUP BY day, repo""",
    "queue_claimable_anti": "SELECT 'queue-' || event_id || '-' || event_type || '.md' AS name FROM events WHERE event_id % 5 <> 0",
    "raw_path_collisions": f"""WITH e AS (SELECT extraction_id, 'raw/' || {_D('extracted_at')} || '-web-' || {slug_sql('title')} AS base FROM extraction WHERE title IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY extraction_id) AS n FROM e)
SELECT extraction_id, coalesce(CASE WHEN n = 1 THEN base || '.md' WHEN n <= 9 THEN base || '-' || n || '.md' END, '') AS path FROM r""",
    "writer_fanout": f"""WITH t AS (SELECT *, length(coalesce(target_path, '')) > 0 AS has FROM pipeline_record WHERE received_at IS NOT NULL)
SELECT record_seq, target_path AS path, 'page' AS role FROM t WHERE has UNION ALL SELECT record_seq, 'wiki/index.md', 'index' FROM t WHERE has AND target_kind = 'wiki'
UNION ALL SELECT record_seq, 'daily/' || {_D('received_at')} || '/drops.md', 'log' FROM t UNION ALL SELECT record_seq, 'MEMORY.md', 'pointer' FROM t WHERE has AND target_kind IN ('project', 'wiki')
UNION ALL SELECT record_seq, 'log/decisions.md', 'decision' FROM t""",
    "index_upsert": """SELECT slug, entry_id, summary FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY entry_date DESC NULLS LAST, entry_id DESC) AS r FROM index_entry) WHERE r = 1""",
    "backlink_insert": f"""{_V} SELECT path, md5(CASE WHEN contains(content, {_NL} || '## Notes') THEN replace(content, '## Notes', '- [[new-page]]' || {_NL} || '## Notes')
 ELSE content || {_NL} || '- [[new-page]]' END) AS digest FROM wiki""",
    "board_merge": """WITH o AS (SELECT ['Active', 'Inactive', 'Done'][CAST(c_custkey % 3 + 1 AS INT)] AS section, c_name AS name, '- [' || c_name || '] — old' AS line, c_custkey FROM customer)
SELECT section, name, line FROM o WHERE c_custkey % 2 <> 0 UNION ALL
SELECT ['Active', 'Inactive', 'Done'][CAST(c_custkey % 5 % 3 + 1 AS INT)], c_name, '- [' || c_name || '] — new' FROM customer WHERE c_custkey % 2 = 0""",
    "archival_sweep": f"{_V} SELECT path, 'archive/' || path AS new_path FROM v WHERE starts_with(path, 'daily/') AND try_cast(split_part(path, '/', 2) AS DATE) < DATE '2024-01-31' - 67",
    "mirror_upsert": f"WITH {_MIRROR} SELECT path, content FROM s UNION ALL SELECT path, content FROM b WHERE path NOT IN (SELECT path FROM s)",
    "mirror_verify": f"""WITH {_MIRROR}, k AS (SELECT (SELECT count(*) FROM s) AS n_source, (SELECT count(*) FROM b) AS n_backup)
SELECT n_source, n_backup, abs(n_source - n_backup) * 100.0 / greatest(n_source, 1) AS delta_percent,
 CASE WHEN n_backup = 0 THEN 'empty' WHEN abs(n_source - n_backup) * 100.0 / greatest(n_source, 1) > 5 THEN 'count_differs' ELSE 'ok' END AS verdict FROM k""",
    "harvest_fresh_anti": "SELECT record_seq, drop_id FROM pipeline_record p WHERE drop_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM harvested_fixture h WHERE h.source_drop_id = p.drop_id)",
    "accept_semi": "SELECT id, category, fixture_no FROM harvested_fixture WHERE id IN (SELECT id FROM harvested_fixture WHERE source_harvest_id >= '2024-01-15')",
    "rollback_filter": "SELECT fixture_no, source_harvest_id FROM harvested_fixture WHERE source_harvest_id IS NULL OR source_harvest_id <> '2024-01-10'",
    "search_scope": f"{_V} SELECT path FROM v WHERE NOT starts_with(path, 'raw/')",
    "since_filter": f"{_V} SELECT path FROM v WHERE mtime IS NULL OR mtime >= TIMESTAMP '2024-01-24 00:00:00'",
    "grep_fixed": f"{_V}, {_LINES} SELECT path, CAST(line_no AS INT) AS line_no, line FROM ln WHERE contains(line, 'lighthouse') AND NOT starts_with(path, 'raw/')",
    "grep_regex": f"{_V}, {_LINES} SELECT path, CAST(line_no AS INT) AS line_no, line FROM ln WHERE regexp_matches(line, '(old|blue) (well|lantern)') AND starts_with(path, 'daily/')",
    "search_wiki": "SELECT entry_id, slug FROM index_entry WHERE contains(lower(concat_ws(' ', slug, summary, array_to_string(tags, ' '))), 'cedar')",
    "pending_live": """SELECT event_id, user_id FROM events WHERE CAST(trunc(abs(epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(ts)) / 60.0) AS BIGINT) < 300000000 AND event_id % 4 <> 0""",
    "broken_wikilinks": f"{_V}, {_BROKEN} SELECT path, target FROM br",
    "orphan_pointers": f"{_V}, {_ORPH} SELECT name, path FROM orph",
    "tag_peers_topk": """WITH i AS (SELECT slug, entry_id, tags FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY entry_date DESC NULLS LAST, entry_id DESC) AS r
 FROM index_entry WHERE len(tags) > 0) WHERE r = 1),
t AS (SELECT DISTINCT slug, entry_id, unnest(tags) AS tag FROM i),
h AS (SELECT a.slug, b.slug AS peer, count(*) AS overlap FROM t a JOIN t b ON a.tag = b.tag AND a.slug <> b.slug WHERE a.entry_id % 100 = 0 GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY slug ORDER BY overlap DESC, peer) AS INT) AS place FROM h) WHERE place <= 5""",
    "tag_peers_all": """WITH i AS (SELECT slug, tags FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY entry_date DESC NULLS LAST, entry_id DESC) AS r
 FROM index_entry WHERE len(tags) > 0) WHERE r = 1),
t AS (SELECT DISTINCT slug, unnest(tags) AS tag FROM i),
h AS (SELECT a.slug, b.slug AS peer, count(*) AS overlap FROM t a JOIN t b ON a.tag = b.tag AND a.slug <> b.slug GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY slug ORDER BY overlap DESC, peer) AS INT) AS place FROM h) WHERE place <= 5""",
    "commits_for_project": f"""WITH {COMMITS_SQL}, p AS (SELECT n_nationkey AS k, 'nation_' || n_nationkey AS slug FROM nation)
SELECT slug, o_orderkey, sha FROM p JOIN c ON CASE WHEN k % 3 = 0 THEN repo = ['automobile', 'building', 'furniture', 'household', 'machinery'][CAST(k % 5 + 1 AS INT)] ELSE o_orderkey % 25 = k END""",
    "mentions_per_day": f"WITH {_MENTIONS} SELECT slug, day, n FROM m",
    "sparkline_points": f"""WITH {_MENTIONS}, p AS (SELECT slug, day, n, min(n) OVER (PARTITION BY slug) AS lo, max(n) OVER (PARTITION BY slug) AS hi, row_number() OVER (PARTITION BY slug ORDER BY day) - 1 AS i FROM m)
SELECT slug, string_agg(printf('%.1f,%.1f', i * (70.0::DOUBLE / 29), 13.0::DOUBLE - (n - lo)::DOUBLE / greatest(hi - lo, 1) * 12.0), ' ' ORDER BY i) AS points FROM p GROUP BY slug""",
    "mention_totals": "SELECT doc_id, (length(lower(text)) - length(replace(lower(text), 'the mayor', ''))) // 9 AS n FROM documents WHERE text IS NOT NULL",
    "drift_diff": f"""WITH {_CASS} SELECT n.agent, n.prompt_hash, CASE WHEN o.prompt_hash IS NULL THEN 'new_entry' ELSE 'diff' END AS status
 FROM n LEFT JOIN o ON n.agent = o.agent AND n.prompt_hash = o.prompt_hash WHERE o.prompt_hash IS NULL OR n.response IS DISTINCT FROM o.response""",
    "ablation_divergence": f"""WITH {_CASS}, j AS (SELECT o.target_kind IS DISTINCT FROM n.target_kind AS a, o.slug IS DISTINCT FROM n.slug AS b, o.confidence IS DISTINCT FROM n.confidence AS d FROM o JOIN n USING (prompt_hash))
SELECT count(*) AS n, count(*) FILTER (WHERE a OR b OR d) AS diverged, count(*) FILTER (WHERE a) AS target_kind_differs, count(*) FILTER (WHERE b) AS slug_differs,
 count(*) FILTER (WHERE d) AS confidence_differs, count(*) FILTER (WHERE a OR b OR d) / count(*) AS share, count(*) FILTER (WHERE a OR b OR d) / count(*) < 0.02 AS no_effect FROM j""",
    "cassette_replay": f"""WITH {_CASS}, x AS (SELECT prompt_hash, max(response) AS response FROM o GROUP BY prompt_hash)
SELECT n0.classification_id, x.prompt_hash IS NOT NULL AS hit, coalesce(x.response, '') AS response FROM n0 LEFT JOIN x USING (prompt_hash)""",
    "cassette_usage": f"""WITH {_CASS} SELECT agent, count(*) AS calls, CAST(sum(length(coalesce(slug, ''))) AS BIGINT) AS tokens,
 round(avg(CASE WHEN classification_id % 4 <> 0 THEN CAST(classification_id % 900 AS DOUBLE) END), 6) AS avg_latency_ms FROM o GROUP BY agent""",
    "json_deep_diff": f"""WITH {_CASS}, fo AS (SELECT classification_id, f.k AS field, f.v AS v FROM (SELECT classification_id, unnest([{{'k': 'target_kind', 'v': target_kind}}, {{'k': 'slug', 'v': slug}}, {{'k': 'confidence', 'v': confidence}}, {{'k': 'life_area', 'v': life_area}}]) AS f FROM o) WHERE f.v IS NOT NULL),
fn AS (SELECT classification_id, f.k AS field, f.v AS v FROM (SELECT classification_id, unnest([{{'k': 'target_kind', 'v': target_kind}}, {{'k': 'slug', 'v': slug}}, {{'k': 'confidence', 'v': confidence}}, {{'k': 'life_area', 'v': life_area}}]) AS f FROM n) WHERE f.v IS NOT NULL)
SELECT classification_id, field, CASE WHEN fo.v IS NULL THEN 'added' WHEN fn.v IS NULL THEN 'removed' ELSE 'changed' END AS change
 FROM fo FULL JOIN fn USING (classification_id, field) WHERE fo.v IS DISTINCT FROM fn.v""",
    "lookup_with_fallback": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS content FROM part",
    "tag_cloud": "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM index_entry) WHERE tag IS NOT NULL GROUP BY tag ORDER BY n DESC, tag LIMIT 12",
    "commit_digest": f"""WITH {COMMITS_SQL} SELECT repo, type, count(*) AS n, count(*) FILTER (WHERE breaking) AS n_breaking FROM c GROUP BY repo, type
UNION ALL SELECT repo, 'all', count(*), count(*) FILTER (WHERE breaking) FROM c GROUP BY repo""",
    "onboarding_distinct": """SELECT expected.target_kind AS target_kind, count(DISTINCT source_harvest_id) AS harvests, count(DISTINCT source_harvest_id) >= 3 AS onboarded FROM harvested_fixture GROUP BY 1""",
    "lint_summary": f"""{_V}, {_BROKEN}, {_ORPH} SELECT 'broken_links' AS "check", count(*) AS n FROM br UNION ALL SELECT 'orphan_pointers', count(*) FROM orph
UNION ALL SELECT 'demoted', count(*) FROM index_entry WHERE entry_id % 3 = 0 AND DATE '2024-01-31' - entry_date > 30""",
    "weekly_context": f"""WITH d AS (SELECT {_D('received_at')} AS day, coalesce(drop_type, '') || ': ' || count(*) AS r FROM pipeline_record
 WHERE received_at BETWEEN TIMESTAMPTZ '2024-01-22 00:00:00+00' AND TIMESTAMPTZ '2024-01-29 00:00:00+00' GROUP BY {_D('received_at')}, drop_type)
SELECT day, substr(string_agg(r, chr(10) ORDER BY r), 1, 1500) AS context FROM d GROUP BY day""",
    "index_regenerate": f"""SELECT 'wiki/' || slug || '-' || entry_id || '.md' AS path, '- [[' || slug || '-' || entry_id || ']] — ' ||
 trim(substr(coalesce(nullif(trim(coalesce(summary, '')), ''), '- [[' || slug || '-' || (entry_id + entry_id % 3) || ']]'), 1, 60)) || ' [' ||
 array_to_string(list_transform(list_slice(list_filter(list_transform(coalesce(tags, []), lambda t: trim(t, ' "''')), lambda t: t <> ''), 1, 5), lambda t: '#' || t), ' ') || '] (' || {_CREATED} || ')' AS line FROM index_entry""",
    "escalation_two_pass": """SELECT record_seq, CASE WHEN coalesce(escalated, FALSE) THEN 2 ELSE 1 END AS passes,
 CASE WHEN coalesce(escalated, FALSE) AND NOT coalesce(verifier_ok, FALSE) THEN 'blocked' ELSE target_confidence END AS target_confidence FROM pipeline_record""",
}
