"""Bindings of page texts, digests, snapshots, boards and logs composed from several parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import dates, text, urls
from quillspark.operators import evals, pages, search
from quillspark.plans.page_queries import _BROKEN, _CASS, _V, _cassettes, _pages, _wiki
from quillspark.plans.scalar_queries import COMMITS_SQL, URLS_SQL, _commits, _dispatch, _urls
from quillspark.sources import vault
from quillspark.sources.tables import table

#: Life areas of the derived pages, by number.
AREAS = ("career", "health", "finance", "read-watch", "credentials")


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


def _pick(values, k):
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


# ---- sources and page texts ------------------------------------------------------


def raw_page(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "extraction").select("extraction_id", "title", "content")
    u = _urls(spark, sf).join(e, "extraction_id")
    facts = F.map_filter(F.create_map(F.lit("published"), _day("extracted_at"), F.lit("authors"), "title", F.lit("other"), F.lit("x")), lambda k, v: v.isNotNull())
    page = text.raw_markdown(F.coalesce("content", F.lit("")), F.col("title"), urls.dispatch(F.col("url")), F.col("url"), _day("extracted_at"), F.lit("html"), F.when(F.col("extraction_id") % 3 == 0, "partial"), facts)
    return u.select("extraction_id", F.md5(page).alias("digest"))


def pipeline_snippet(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.md5(text.pipeline_snippet(F.col("text"), F.concat(F.lit("https://d.example/"), "doc_id"), F.lit("web"))).alias("digest"))


def html_text(spark: SparkSession, sf: str) -> DataFrame:
    """Subtitles wrapped in a page with a script, a style and entities."""
    page = F.concat(F.lit("<html><head><STYLE>p {a: b}</STYLE><script>if (a < b) x()</script></head><!-- note --><p>"), "text", F.lit("</p><br/>fish &amp; chips&nbsp;&lt;5&gt;"))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(text.html_text(page)).alias("digest"))


def wiki_page_render(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "extraction").where("kind = 'concept_drop' and title is not null")
    url = F.col("source_url")
    page = text.wiki_page(F.col("title"), F.col("summary"), F.col("key_claims"), url, urls.source_type(url), urls.authority(url), _day("extracted_at"))
    return e.select("extraction_id", page.alias("page"))


def project_page_render(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "extraction").where("kind = 'project_update' and title is not null")
    status = F.when(F.col("extraction_id") % 3 == 0, "done")
    page = text.project_page(F.col("title"), F.col("summary"), status, F.lit(""), F.when(F.col("extraction_id") % 4 == 0, "waits"))
    return e.select("extraction_id", page.alias("page"))


def life_entry_render(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "extraction").where("kind = 'life_entry' and content is not null and extracted_at is not null")
    page = text.life_entry(F.date_format("extracted_at", "yyyy-MM-dd HH:mm"), F.col("title"), F.col("extraction_id").cast("string"), F.col("content"), F.col("context"))
    return e.select("extraction_id", F.md5(page).alias("digest"))


def decision_log(spark: SparkSession, sf: str) -> DataFrame:
    """Log entry of every run with the pages it wrote, credentials redacted."""
    t = table(spark, sf, "pipeline_record").where("received_at is not null and drop_type is not null")
    writes = F.array_compact(F.array(F.when(F.length("target_path") > 0, F.col("target_path")), F.lit("log/decisions.md")))
    entry = text.decision_entry(F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss"), F.col("drop_type"), F.coalesce("target_kind", F.lit("daily_only")), F.coalesce("slug", F.lit("")), F.coalesce("target_confidence", F.lit("low")), writes, F.coalesce("blocked_reason", F.lit("ok")))
    return t.select("record_seq", F.md5(entry).alias("digest"))


def commit_messages(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "pipeline_record").where("drop_type is not null")
    return t.select("record_seq", text.commit_message(F.coalesce("target_kind", F.lit("")), F.col("drop_type"), F.coalesce("target_path", F.lit("")), F.coalesce("slug", F.lit("")), "notes").alias("message"))


def run_log_page(spark: SparkSession, sf: str) -> DataFrame:
    """Page of each run of a job; its rows count is an extra line."""
    e = table(spark, sf, "events")
    ok = F.col("event_id") % 6 != 0
    extra = F.array(F.struct(F.lit("rows").alias("name"), F.col("user_id").cast("string").alias("value")))
    page = text.run_log(F.col("event_type"), _day("ts"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), (F.col("event_id") % 1000) / 8.0, ok, F.when(~ok, "ValueError: x"), extra)
    return e.select("event_id", page.alias("page"))


# ---- digest, snapshots, boards ---------------------------------------------------


def digest_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Digest of a day as numbered rows: repositories in order, types in their fixed order with
    their counts, breaking commits marked and listed again at the end. One row per line, so no
    repository is gathered in one task."""
    c = _commits(spark, sf)
    types = list(text.COMMIT_LABELS)
    order = F.array_position(F.array(*map(F.lit, types)), F.col("type")).cast("int")
    label = F.element_at(F.create_map(*(F.lit(x) for kv in text.COMMIT_LABELS.items() for x in kv)), F.col("type"))
    head = c.groupBy("day", "repo").agg(F.count("*").alias("n")).select("day", "repo", F.lit(0).alias("part"), F.lit(-1).cast("long").alias("k"), F.concat(F.lit("### "), "repo", F.lit(" ("), "n", F.lit(")")).alias("line"))
    group = c.groupBy("day", "repo", "type").agg(F.count("*").alias("n")).select("day", "repo", order.alias("part"), F.lit(-1).cast("long").alias("k"), F.concat(F.lit("**"), label, F.lit(" ("), "n", F.lit(")**")).alias("line"))
    line = lambda flag: F.concat(F.lit("- `"), "sha", F.lit("` "), "day", F.lit(" 00:00 [bot] "), flag, "message")
    each = c.select("day", "repo", order.alias("part"), F.col("o_orderkey").alias("k"), line(F.when(F.col("breaking"), "⚠ ").otherwise("")).alias("line"))
    broken = c.where("breaking")
    last = F.lit(len(types) + 1).alias("part")
    title = broken.select("day", "repo").distinct().select("day", "repo", last, F.lit(-1).cast("long").alias("k"), F.lit("**Breaking changes**").alias("line"))
    again = broken.select("day", "repo", last, F.col("o_orderkey").alias("k"), line(F.lit("")).alias("line"))
    return head.unionByName(group).unionByName(each).unionByName(title).unionByName(again)


def _life(spark: SparkSession, sf: str) -> DataFrame:
    """(path, area, n, ts, title): entries of the page of each life area, in file order."""
    e = table(spark, sf, "extraction").where("kind = 'life_entry' and title is not null and extracted_at is not null")
    area = _pick(AREAS, F.col("extraction_id"))
    return e.select(F.concat(F.lit("life/"), area, F.lit(".md")).alias("path"), area.alias("area"), F.col("extraction_id").alias("n"), F.date_format("extracted_at", "yyyy-MM-dd HH:mm").alias("ts"), F.regexp_replace("title", "\n", " ").alias("title"))


def query_life(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of one area within 30 days, the last of its page first."""
    return pages.life_of_area(_life(spark, sf), "life/health.md", "2024-01-01 00:00", search.LIMITS["life"]).select("path", "ts", "title")


def life_brief(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of each area since the day before: their number and titles."""
    e = _life(spark, sf).withColumn("title", F.concat("title", F.lit(" #"), F.col("n").cast("string")))
    return pages.life_snapshots(e, "area", "ts", "title", F.lit("2024-01-29 00:00"))


def recent_wiki(spark: SparkSession, sf: str) -> DataFrame:
    """The ten newest index rows; rows without a date come last."""
    i = table(spark, sf, "index_entry").select("entry_id", "slug", F.coalesce(_day("entry_date"), F.lit("")).alias("day"))
    return i.orderBy(F.desc("day"), "entry_id").limit(10)


def lint_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten broken links of a lint page."""
    return pages.broken_links(_wiki(spark, sf)).distinct().orderBy("path", "target").limit(10)


def search_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first fifty lines of a search on the command line."""
    return search.first_hits(search.grep(search.scope(_pages(spark, sf)), "lighthouse")).select("path", "line_no")


def search_wiki_first(spark: SparkSession, sf: str) -> DataFrame:
    return search.wiki(table(spark, sf, "index_entry"), "Cedar", search.LIMITS["wiki"]).select("slug", "entry_id")


def _cards(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "extraction").where("kind = 'project_update'").withColumn("k", F.col("extraction_id"))
    where = F.when(F.col("k") % 7 == 0, "projects/archive/p").otherwise("projects/p")
    due = F.col("extracted_at") + F.expr("make_dt_interval(cast(extraction_id % 120 as int))")
    d = dates.deadline_label(due, F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return e.select(F.concat(where, F.lpad(F.col("k").cast("string"), 9, "0"), F.lit(".md")).alias("path"), F.concat(F.lit("p"), F.lpad(F.col("k").cast("string"), 9, "0")).alias("slug"), _pick(("active", "inactive", ""), F.col("k")).alias("status"), F.when(F.col("k") % 50 == 0, "waits").otherwise("").alias("blocker"), F.coalesce("summary", F.lit("")).alias("note"), d["label"].alias("label"), d["level"].alias("level"))


def project_groups(spark: SparkSession, sf: str) -> DataFrame:
    return pages.project_groups(_cards(spark, sf))


def critical_path(spark: SparkSession, sf: str) -> DataFrame:
    return pages.critical(_cards(spark, sf).where("path not like '%/archive/%'"))


def context_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with the content of their target page and of the drops page of their day."""
    t = table(spark, sf, "pipeline_record").where("received_at is not null").select("record_seq", "slug", "target_path", "received_at")
    i = table(spark, sf, "index_entry")
    wiki = pages.latest(i.where("slug is not null").select("slug", "entry_id", "summary", "entry_date"), "slug", "entry_date", "entry_id")
    targets = wiki.select(F.concat(F.lit("wiki/"), "slug", F.lit(".md")).alias("path"), F.coalesce("summary", F.lit("")).alias("content"))
    counts = t.groupBy(_day("received_at").alias("day")).agg(F.count("*").alias("n"))
    drops = counts.select(F.concat(F.lit("daily/"), "day", F.lit("/drops.md")).alias("path"), F.col("n").cast("string").alias("content"))
    store = targets.unionByName(drops)
    j = pages.with_pages(t, store, target=F.concat(F.lit("wiki/"), "slug", F.lit(".md")), drops=F.concat(F.lit("daily/"), _day("received_at"), F.lit("/drops.md")), memory=F.lit("MEMORY.md"))
    return j.select("record_seq", F.md5("target").alias("target"), "drops", "memory")


def frontmatter_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Every field of a page header, with what was wrong with it."""
    p = _wiki(spark, sf).select("path", vault.header_fields(vault.frontmatter(F.col("content"))["header"]).alias("h"))
    return p.select("path", F.col("h.fields")["confidence"].alias("confidence"), F.coalesce(F.col("h.fields")["created"], F.lit("")).alias("created"), F.size("h.fields").alias("n_fields"), F.coalesce("h.error", F.lit("")).alias("error"))


def week_days(spark: SparkSession, sf: str) -> DataFrame:
    m = dates.last_monday(F.col("ts"))
    days = F.transform(F.sequence(m, F.date_add(m, 6)), lambda d: _day(d))
    return table(spark, sf, "events").select("event_id", F.array_join(days, " ").alias("days"))


# ---- evaluation ------------------------------------------------------------------


def accept_append(spark: SparkSession, sf: str) -> DataFrame:
    """What an approval adds: proposals of a day that have not expired, without ids accepted before."""
    h = table(spark, sf, "harvested_fixture").where("id is not null")
    pending = h.where("source_harvest_id >= '2024-01-15'").select("id", (F.col("fixture_no") % 100).alias("expires_at"))
    before = h.where("fixture_no % 3 = 0").select("id")
    return evals.accepted_rows(pending, h.select("id", "category", "fixture_no"), before, "id", 50).select("id", "category", "fixture_no")


def response_diffs(spark: SparkSession, sf: str) -> DataFrame:
    """Nested differences of recorded responses: every third new one lost a field, every fifth is plain text."""
    old, new = _cassettes(spark, sf)
    doc = lambda d, *cut: F.to_json(F.struct("target_kind", "slug", F.struct("confidence", F.array("life_area").alias("areas")).alias("more")))
    j = old.select("classification_id", doc(old).alias("a")).join(new.select("classification_id", doc(new).alias("b")), "classification_id")
    j = j.withColumn("b", F.when(F.col("classification_id") % 5 == 0, "plain").otherwise(F.col("b")))
    d = evals.response_diff(j, "a", "b").select("classification_id", F.explode("diffs").alias("d"))
    return d.select("classification_id", "d.path", "d.kind").distinct()


QUERIES = {
    f.__name__: f
    for f in (
        raw_page, pipeline_snippet, html_text, wiki_page_render, project_page_render, life_entry_render, decision_log, commit_messages, run_log_page,
        digest_lines, query_life, life_brief, recent_wiki, lint_listing, search_first, search_wiki_first, project_groups, critical_path,
        context_pages, frontmatter_fields, week_days, accept_append, response_diffs,
    )
}

_NL = "chr(10)"
_UTC = lambda c, f: f"strftime({c} AT TIME ZONE 'UTC', '{f}')"
_AREA = f"{list(AREAS)}[CAST(extraction_id % {len(AREAS)} + 1 AS INT)]"
_LIFE = f"""lf AS (SELECT 'life/' || {_AREA} || '.md' AS path, {_AREA} AS area, extraction_id AS n, {_UTC('extracted_at', '%Y-%m-%d %H:%M')} AS ts, replace(title, {_NL}, ' ') AS title
 FROM extraction WHERE kind = 'life_entry' AND title IS NOT NULL AND extracted_at IS NOT NULL)"""
_RTRIM = lambda c: f"regexp_replace({c}, '[\\s\\p{{Z}}\\x{{0B}}\\x{{85}}]+$', '')"
_DUE = "floor((floor(epoch(extracted_at)) + (extraction_id % 120) * 86400 - epoch(TIMESTAMPTZ '2024-01-31 00:00:00+00')) / 86400)"
_CARDS = f"""k AS (SELECT CASE WHEN extraction_id % 7 = 0 THEN 'projects/archive/p' ELSE 'projects/p' END || lpad(CAST(extraction_id AS VARCHAR), 9, '0') || '.md' AS path,
 'p' || lpad(CAST(extraction_id AS VARCHAR), 9, '0') AS slug, ['active', 'inactive', ''][CAST(extraction_id % 3 + 1 AS INT)] AS status, CASE WHEN extraction_id % 50 = 0 THEN 'waits' ELSE '' END AS blocker,
 coalesce(summary, '') AS note, CAST({_DUE} AS INT) AS d FROM extraction WHERE kind = 'project_update'),
cards AS (SELECT *, CASE WHEN d IS NULL THEN '—' WHEN d < 0 THEN 'overdue ' || (-d) || 'd' ELSE '+' || d || 'd' END AS label, CASE WHEN d IS NULL THEN 'ok' WHEN d <= 7 THEN 'urgent' WHEN d <= 30 THEN 'warn' ELSE 'ok' END AS level FROM k)"""
_TLDR = "trim(coalesce(summary, ''))"
_N = f"length(regexp_extract({_TLDR}, '(?s)^(.*?[.?!])\\s', 1))"
_ORDER = "list_position([" + ", ".join(f"'{t}'" for t in text.COMMIT_LABELS) + "], type)"
_LABEL = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.COMMIT_LABELS.items()) + " END"
_LINE = "'- `' || sha || '` ' || day || ' 00:00 [bot] '"
_TEXT = "replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[A-Za-z/!][^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"')"
_MON = "CAST(ts AS DATE) - CAST(isodow(ts) - 1 + CASE WHEN isodow(ts) = 1 AND hour(ts) < 22 THEN 7 ELSE 0 END AS INT)"

SQL = {
    "raw_page": f"""WITH {URLS_SQL} SELECT u.extraction_id, md5(concat_ws({_NL}, '# ' || coalesce(nullif(e.title, ''), url), '', '- Source: ' || {_dispatch('url')}, '- URL: ' || url, '- Extracted: ' || {_UTC('u.extracted_at', '%Y-%m-%d')},
 '- Method: html', CASE WHEN u.extraction_id % 3 = 0 THEN '- Warning: partial' END, '', '- authors: ' || e.title, '- published: ' || {_UTC('u.extracted_at', '%Y-%m-%d')}, '', '---', '', coalesce(e.content, ''))) AS digest
 FROM u JOIN extraction e ON e.extraction_id = u.extraction_id""",
    "pipeline_snippet": f"""WITH t AS (SELECT doc_id, regexp_replace({_RTRIM('text')}, '^[\\s\\p{{Z}}\\x{{0B}}\\x{{85}}]+', '') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5({_NL} || {_NL} || '[Extracted from https://d.example/' || doc_id || ' (web)]' || {_NL} || CASE WHEN length(t) > 2000 THEN {_RTRIM('substr(t, 1, 2000)')} || '…' || {_NL} || '[truncated — full text in raw/]' ELSE t END) AS digest FROM t""",
    "html_text": f"""WITH p AS (SELECT doc_id, '<html><head><STYLE>p {{a: b}}</STYLE><script>if (a < b) x()</script></head><!-- note --><p>' || text || '</p><br/>fish &amp; chips&nbsp;&lt;5&gt;' AS page FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, replace(replace({_TEXT.format('page')}, '&#39;', ''''), '&amp;', '&') AS t FROM p)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(t, '[ \\t\\r]+', ' ', 'g'), ' ?\\n[ \\n]*', {_NL}, 'g'), ' ' || {_NL})) AS digest FROM x""",
    "wiki_page_render": f"""WITH e AS (SELECT *, {_N} AS n, {_TLDR} AS s FROM extraction WHERE kind = 'concept_drop' AND title IS NOT NULL),
p AS (SELECT *, CASE WHEN n > 0 THEN trim(substr(s, 1, n)) ELSE s END AS tldr, CASE WHEN n > 0 THEN trim(substr(s, n + 1)) ELSE '' END AS rest, lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS domain FROM e)
SELECT extraction_id, concat_ws({_NL}, '# ' || title || {_NL}, CASE WHEN tldr <> '' THEN '> ' || tldr || {_NL} END,
 CASE WHEN len(key_claims) > 0 THEN '## Key points' || {_NL} || {_NL} || array_to_string(list_transform(list_filter(key_claims, lambda x: x IS NOT NULL), lambda x: '- ' || x), {_NL}) || {_NL} END,
 CASE WHEN rest <> '' THEN '## Overview' || {_NL} || {_NL} || rest || {_NL} END,
 CASE WHEN length(source_url) > 0 THEN '## Source' || {_NL} || {_NL} || concat_ws({_NL}, '- **URL**: <' || source_url || '>', CASE WHEN domain <> '' THEN '- **Domain**: `' || domain || '`' END, '- **Type**: ' ||
 CASE WHEN lower(source_url) LIKE '%arxiv.org%' THEN 'paper' WHEN lower(source_url) LIKE '%github.com%' THEN 'code' WHEN lower(source_url) LIKE '%youtube.com%' OR lower(source_url) LIKE '%youtu.be%' THEN 'video'
 WHEN lower(source_url) LIKE '%stackoverflow.com%' OR lower(source_url) LIKE '%stackexchange.com%' THEN 'discussion' WHEN lower(source_url) LIKE '%.pdf' OR lower(source_url) LIKE '%/pdf/%' THEN 'pdf' ELSE 'web' END,
 '- **Accessed**: ' || {_UTC('extracted_at', '%Y-%m-%d')}) || {_NL} END, '## Related' || {_NL}) AS page FROM p""",
    "project_page_render": f"""SELECT extraction_id, concat_ws({_NL}, '# ' || title, '', '- **Progress:** ' || coalesce(summary, ''), CASE WHEN extraction_id % 3 = 0 THEN '- **Status:** done' END,
 CASE WHEN extraction_id % 4 = 0 THEN '- **Blocker:** waits' END) || {_NL} AS page FROM extraction WHERE kind = 'project_update' AND title IS NOT NULL""",
    "life_entry_render": f"""SELECT extraction_id, md5(concat_ws({_NL}, '## ' || {_UTC('extracted_at', '%Y-%m-%d %H:%M')} || ' — ' || coalesce(nullif(title, ''), CAST(extraction_id AS VARCHAR)), '', {_RTRIM('content')},
 CASE WHEN length(context) > 0 THEN {_NL} || '_Context: ' || context || '_' END) || {_NL}) AS digest FROM extraction WHERE kind = 'life_entry' AND content IS NOT NULL AND extracted_at IS NOT NULL""",
    "decision_log": f"""SELECT record_seq, md5({_NL} || '## ' || {_UTC('received_at', '%Y-%m-%dT%H:%M:%S')} || {_NL} || 'Pipeline: ' || drop_type || {_NL} || 'Target: ' || coalesce(target_kind, 'daily_only') || ' / slug=' ||
 CASE WHEN target_kind = 'credential' THEN '(redacted)' ELSE coalesce(slug, '') END || {_NL} || 'Path: orchestrator → classifier → extractor → verifier → writer' || {_NL} || 'Confidence: ' || coalesce(target_confidence, 'low') || {_NL} ||
 'Writes: ' || CASE WHEN length(target_path) > 0 THEN CASE WHEN starts_with(target_path, 'life/credentials/') THEN 'life/credentials/(redacted)' ELSE target_path END || ', ' ELSE '' END || 'log/decisions.md' || {_NL} ||
 'Reasoning: ' || coalesce(blocked_reason, 'ok') || {_NL}) AS digest FROM pipeline_record WHERE received_at IS NOT NULL AND drop_type IS NOT NULL""",
    "commit_messages": """SELECT record_seq, CASE WHEN target_kind = 'credential' THEN 'notes: credential (redacted)' ELSE 'notes: ' || drop_type || ' — ' ||
 substr(CASE WHEN length(target_path) > 0 THEN regexp_replace(list_extract(string_split(target_path, '/'), -1), '[.]md$', '') ELSE coalesce(slug, '') END, 1, 40) END AS message FROM pipeline_record WHERE drop_type IS NOT NULL""",
    "run_log_page": f"""SELECT event_id, concat_ws({_NL}, '# ' || event_type || ' — ' || strftime(ts, '%Y-%m-%d'), '', 'started_at: ' || strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'duration_s: ' || CAST(CAST(floor((event_id % 1000) / 8.0 * 100 + 0.5) AS BIGINT) // 100 AS VARCHAR) || '.' || lpad(CAST(CAST(floor((event_id % 1000) / 8.0 * 100 + 0.5) AS BIGINT) % 100 AS VARCHAR), 2, '0'),
 'ok: ' || CASE WHEN event_id % 6 <> 0 THEN 'True' ELSE 'False' END, CASE WHEN event_id % 6 = 0 THEN 'error: ValueError: x' END, 'rows: ' || user_id) || {_NL} AS page FROM events""",
    "digest_lines": f"""WITH {COMMITS_SQL} SELECT day, repo, 0 AS part, CAST(-1 AS BIGINT) AS k, '### ' || repo || ' (' || count(*) || ')' AS line FROM c GROUP BY day, repo
UNION ALL SELECT day, repo, {_ORDER}, -1, '**' || {_LABEL} || ' (' || count(*) || ')**' FROM c GROUP BY day, repo, type
UNION ALL SELECT day, repo, {_ORDER}, o_orderkey, {_LINE} || CASE WHEN breaking THEN '⚠ ' ELSE '' END || message FROM c
UNION ALL SELECT DISTINCT day, repo, {len(text.COMMIT_LABELS) + 1}, CAST(-1 AS BIGINT), '**Breaking changes**' FROM c WHERE breaking
UNION ALL SELECT day, repo, {len(text.COMMIT_LABELS) + 1}, o_orderkey, {_LINE} || message FROM c WHERE breaking""",
    "query_life": f"WITH {_LIFE} SELECT path, ts, title FROM lf WHERE area = 'health' AND ts >= '2024-01-01 00:00' ORDER BY n DESC LIMIT 20",
    "life_brief": f"""WITH {_LIFE} SELECT area, count(*) AS n, string_agg(title || ' #' || n, {_NL} ORDER BY ts, title || ' #' || n) AS titles FROM lf WHERE ts >= '2024-01-29 00:00' AND area <> 'credentials' GROUP BY area""",
    "recent_wiki": "SELECT entry_id, slug, coalesce(strftime(entry_date, '%Y-%m-%d'), '') AS day FROM index_entry ORDER BY 3 DESC, 1 LIMIT 10",
    "lint_listing": f"{_V}, {_BROKEN} SELECT DISTINCT path, target FROM br ORDER BY path, target LIMIT 10",
    "search_first": f"""{_V}, ln AS (SELECT path, unnest(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10))) AS line, unnest(range(1, len(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10))) + 1)) AS line_no FROM v)
SELECT path, CAST(line_no AS INT) AS line_no FROM ln WHERE contains(line, 'lighthouse') AND NOT starts_with(path, 'raw/') ORDER BY path, line_no LIMIT 50""",
    "search_wiki_first": "SELECT slug, entry_id FROM index_entry WHERE contains(lower(concat_ws(' ', slug, summary, array_to_string(tags, ' '))), 'cedar') ORDER BY slug, entry_id LIMIT 10",
    "project_groups": f"""WITH {_CARDS} SELECT path, CASE WHEN coalesce(nullif(status, ''), 'active') = 'active' THEN 'active' ELSE 'inactive' END AS grp FROM cards WHERE path NOT LIKE '%/archive/%'
UNION ALL (SELECT path, 'done' FROM cards WHERE path LIKE '%/archive/%' ORDER BY path LIMIT 5)""",
    "critical_path": f"""WITH {_CARDS} SELECT slug, coalesce(nullif(blocker, ''), note) AS description, CASE WHEN level <> 'ok' THEN label ELSE '' END AS label FROM cards
 WHERE path NOT LIKE '%/archive/%' AND (blocker <> '' OR level = 'urgent') ORDER BY slug LIMIT 3""",
    "context_pages": f"""WITH w AS (SELECT slug, coalesce(summary, '') AS c FROM index_entry WHERE slug IS NOT NULL QUALIFY row_number() OVER (PARTITION BY slug ORDER BY entry_date DESC NULLS LAST, entry_id DESC) = 1),
t AS (SELECT record_seq, slug, {_UTC('received_at', '%Y-%m-%d')} AS day FROM pipeline_record WHERE received_at IS NOT NULL)
SELECT record_seq, md5(coalesce(w.c, '')) AS target, CAST(count(*) OVER (PARTITION BY day) AS VARCHAR) AS drops, '' AS memory FROM t LEFT JOIN w USING (slug)""",
    "frontmatter_fields": """SELECT 'wiki/' || slug || '-' || entry_id || '.md' AS path, ['high', 'medium', 'low'][CAST(entry_id % 3 + 1 AS INT)] AS confidence, coalesce(strftime(entry_date, '%Y-%m-%d'), '') AS created,
 2 + CAST(entry_date IS NOT NULL AS INT) AS n_fields, '' AS error FROM index_entry""",
    "week_days": f"SELECT event_id, array_to_string(list_transform(range(7), lambda i: strftime({_MON} + CAST(i AS INT), '%Y-%m-%d')), ' ') AS days FROM events",
    "accept_append": """SELECT id, category, fixture_no FROM harvested_fixture h WHERE id IN (SELECT id FROM harvested_fixture WHERE source_harvest_id >= '2024-01-15' AND fixture_no % 100 >= 50)
 AND id NOT IN (SELECT id FROM harvested_fixture WHERE fixture_no % 3 = 0)""",
    "response_diffs": f"""WITH {_CASS}, j AS (SELECT classification_id, o.confidence IS DISTINCT FROM n.confidence AS differs, o.confidence IS NULL AS had_none, n.confidence IS NULL AS has_none FROM o JOIN n USING (classification_id))
SELECT DISTINCT classification_id, '/' AS path, 'text' AS kind FROM j WHERE classification_id % 5 = 0
UNION SELECT classification_id, '/more/confidence', CASE WHEN had_none THEN 'added' WHEN has_none THEN 'removed' ELSE 'value' END FROM j WHERE classification_id % 5 <> 0 AND differs""",
}
