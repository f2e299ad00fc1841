"""Bindings of the scalar functions. Inputs are derived from the test tables; each SQL
states the same derivation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import dates, scrub, text, urls
from quillspark.operators.delivery import instant
from quillspark.sources.tables import table

CLOCK = "2024-01-31 00:00:00"
#: Placeholder of the add-event page.
CALENDAR = "https://calendar.google.com/calendar/render"


def _now():
    return F.lit(CLOCK).cast("timestamp")


def slugify(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.slugify(F.col("text")).alias("slug"))


def normalize_literal(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "pipeline_record").select("record_seq", F.coalesce("target_kind", F.lit("")).alias("k"))
    return t.select("record_seq", text.normalize_literal(F.col("k"), text.KINDS, "daily_only").alias("kind"))


def normalize_life_area(spark: SparkSession, sf: str) -> DataFrame:
    names = [r[0] for r in table(spark, sf, "life_category").select("life_category").orderBy("life_category").limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("a configured list of areas is short")
    areas = F.array(*map(F.lit, names))
    c = table(spark, sf, "classification").where("life_area is not null").select("classification_id", "life_area").distinct()
    return c.select("classification_id", "life_area", text.life_area(F.col("life_area"), areas).alias("area"))


def derive_path(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "classification").select("classification_id", "target_kind", "slug", "life_area").distinct()
    return c.select("classification_id", "target_kind", "slug", "life_area", text.derive_path(F.col("target_kind"), F.col("slug"), F.col("life_area")).alias("path"))


def drop_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", text.drop_id(F.col("text")).alias("drop_id"))


def truncate_snippet(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


def split_tldr(spark: SparkSession, sf: str) -> DataFrame:
    joined = F.concat_ws(". ", "title", "summary")
    e = table(spark, sf, "extraction").where("summary is not null").select("extraction_id", text.split_tldr(joined).alias("s"))
    return e.select("extraction_id", "s.tldr", "s.rest")


def url_slug(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).select("extraction_id", "url", urls.url_slug(F.col("url")).alias("slug"))


def raw_path(spark: SparkSession, sf: str) -> DataFrame:
    u = _urls(spark, sf)
    return u.select("extraction_id", urls.raw_path(F.date_format("extracted_at", "yyyy-MM-dd"), urls.dispatch(F.col("url")), urls.url_slug(F.col("url"))).alias("path"))


def _urls(spark: SparkSession, sf: str) -> DataFrame:
    """Source URLs, rewritten by row number so that every class of URL occurs."""
    e = table(spark, sf, "extraction").where("source_url is not null").withColumn("k", F.col("extraction_id") % 12)
    tail = F.element_at(F.split("source_url", "/"), -1)
    num = F.lpad((F.col("extraction_id") % 100000).cast("string"), 5, "0")
    vid = F.substring(F.concat(F.replace(tail, F.lit("-"), F.lit("_")), F.lit("___________")), 1, 11)
    forms = {
        1: F.concat(F.lit("https://arxiv.org/abs/2301."), num, F.lit("v2")),
        2: F.concat(F.lit("https://www.youtube.com/watch?v="), vid),
        3: F.concat(F.lit("https://youtu.be/"), vid, F.lit("?t=3")),
        4: F.concat(F.lit("https://github.com/"), tail, F.lit("/repo")),
        5: F.concat(F.col("source_url"), F.lit(".PDF")),
        6: F.concat(F.col("source_url"), F.lit("/report.docx")),
        7: F.concat(F.lit("https://www.instagram.com/p/"), tail, F.lit("/")),
        8: F.concat(F.lit("https://stackoverflow.com/questions/"), num, F.lit("/"), tail),
        9: F.concat(F.lit("http://user@10.0."), F.col("extraction_id") % 256, F.lit(".7:8080/x")),
        10: F.concat(F.lit("http://100."), F.col("extraction_id") % 256, F.lit(".100.200/latest")),
        11: F.concat(F.col("source_url"), F.lit("?utm=1#part")),
    }
    url = F.col("source_url")
    for k, v in forms.items():
        url = F.when(F.col("k") == k, v).otherwise(url)
    return e.select("extraction_id", "extracted_at", url.alias("url"))


def source_meta(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).select("extraction_id", urls.source_type(F.col("url")).alias("source_type"), urls.authority(F.col("url")).alias("domain"))


def url_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).select("extraction_id", urls.dispatch(F.col("url")).alias("extractor"), urls.clean_url(F.col("url")).alias("clean"))


def video_id(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).select("extraction_id", urls.video_id(F.col("url")).alias("video_id")).where("video_id is not null")


def arxiv_id(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).select("extraction_id", urls.arxiv_id(F.col("url")).alias("arxiv_id")).where("arxiv_id is not null")


def safe_url_static(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).select("extraction_id", urls.safe_url(F.col("url")).alias("verdict"))


def extract_urls(spark: SparkSession, sf: str) -> DataFrame:
    """URLs of a text that names its own twice among others."""
    u = _urls(spark, sf)
    body = F.concat(F.lit("see "), "url", F.lit(", then ("), "url", F.lit(") and https://a.example/x. or <http://b.example/y>! https://c.example"))
    return u.select("extraction_id", F.concat_ws(" ", urls.extract_urls(body)).alias("urls"))


def enrich_fanout(spark: SparkSession, sf: str) -> DataFrame:
    """One row per URL of a drop, its extractor, and the ordered result per drop again."""
    u = _urls(spark, sf)
    body = F.concat(F.col("url"), F.lit(" https://youtu.be/abcdefghijk https://notes.example/a.pdf"))
    each = u.select("extraction_id", F.posexplode(urls.extract_urls(body)).alias("at", "one")).withColumn("x", urls.dispatch(F.col("one")))
    parts = each.groupBy("extraction_id").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("p"))
    return parts.select("extraction_id", F.concat_ws("+", "p.x").alias("extractors"))


def attachment_class(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("k", F.col("doc_id") % 7)
    exts = [".srt", ".PDF", ".hwp", ".xlsx", ".json", ".png", ".pptx"]
    mimes = ["text/plain", "", "", "application/octet-stream", "", "image/png", "application/vnd.ms-powerpoint"]
    pick = lambda vs: F.element_at(F.array(*map(F.lit, vs)), (F.col("k") + 1).cast("int"))
    return d.select("doc_id", urls.attachment_class(pick(mimes), F.concat(F.lit("f"), F.col("doc_id"), pick(exts))).alias("class"))


def fallback_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """First extraction tier whose text is long enough: 200 characters, then 100, else none."""
    e = table(spark, sf, "extraction").select("extraction_id", F.coalesce("content", F.lit("")).alias("a"), F.coalesce("summary", F.lit("")).alias("b"))
    tier = text.ladder((F.col("a"), 200, "tier1"), (F.col("a"), 100, "tier2"), (F.col("b"), 60, "summary"))
    return e.select("extraction_id", tier.alias("tier"))


def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", text.printable_ok(F.regexp_replace("text", "[\r\n]", " ")).alias("ok"))


def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("length(text) > 0")
    return d.select("doc_id", F.posexplode(text.chunks(F.col("text"), 3800)).alias("part", "chunk")).select("doc_id", "part", F.length("chunk").alias("chars"), F.md5("chunk").alias("digest"))


def html_text_len(spark: SparkSession, sf: str) -> DataFrame:
    """Text of marked-up subtitles with the tags gone."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.length(F.regexp_replace("text", "<[^>]*>", "")).alias("chars"))


def conventional_commit(spark: SparkSession, sf: str) -> DataFrame:
    return _commits(spark, sf).select("sha", "type", "subject", "breaking")


def _commits(spark: SparkSession, sf: str) -> DataFrame:
    """Commits built from orders: repo by market segment, message by priority and status."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    pre = F.element_at(F.array(*map(F.lit, ("feat: ", "fix(core): ", "Docs!: ", "chore: ", "plain ", "perf(api)!: ", "refactor : "))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    first = F.concat(pre, F.lit("order "), "o_orderkey", F.lit(" "), F.lower("o_orderpriority"))
    body = F.when(F.col("o_orderkey") % 11 == 0, "breaking change: totals").otherwise("")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    k = j.select(
        F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 7).alias("sha"), "o_orderkey", F.lower("c_mktsegment").alias("repo"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), first.alias("message"), text.conventional_commit(first, body).alias("c"),
    )
    return k.select("sha", "o_orderkey", "repo", "day", "message", "c.type", "c.subject", "c.breaking")


def schema_route(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pipeline_record").select("record_seq", text.schema_route(F.col("target_kind"), F.col("drop_type")).alias("schema"))


def index_line_render(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "index_entry").where("entry_date is not null")
    return i.select("entry_id", text.index_line(F.col("slug"), F.col("summary"), F.col("tags"), F.date_format("entry_date", "yyyy-MM-dd")).alias("line"))


def memory_pointer_format(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "pipeline_record").where("target_kind in ('project', 'wiki') and target_path is not null and target_confidence is not null")
    return t.select("record_seq", text.memory_line(F.col("target_path"), F.col("slug"), F.col("target_confidence")).alias("line"))


def drop_entry_redacted(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "pipeline_record").where("received_at is not null")
    e = text.drop_entry(F.date_format("received_at", "HH:mm"), F.coalesce("target_kind", F.lit("")), F.col("drop_type"), F.col("target_path"), F.col("slug"))
    return t.select("record_seq", e.alias("entry"))


def calendar_url(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "extraction").where("title is not null and summary is not null")
    day = F.date_format("extracted_at", "yyyy-MM-dd")
    return e.select("extraction_id", text.calendar_url(CALENDAR, F.col("title"), day, F.lit(None).cast("string"), F.concat("summary", F.lit(" ~*+é&")), F.lit("")).alias("url"))


def note_extract(spark: SparkSession, sf: str) -> DataFrame:
    """First paragraph that is prose, and a blocker line, of a page built from each extraction."""
    e = table(spark, sf, "extraction").where("summary is not null")
    body = F.concat(F.lit("# "), F.coalesce("title", F.lit("x")), F.lit("\n\n"), "summary", F.lit("\n\nmore"), F.when(F.col("extraction_id") % 5 == 0, F.concat(F.lit("\n- Blocker: "), F.coalesce("title", F.lit("?")))).otherwise(""))
    return e.select("extraction_id", text.first_paragraph(body).alias("note"), text.blocker(F.lit(""), body).alias("blocker"))


def scrub_email(spark: SparkSession, sf: str) -> DataFrame:
    return _personal(spark, sf).select("extraction_id", scrub.email(F.col("content")).alias("out"))


def scrub_phone(spark: SparkSession, sf: str) -> DataFrame:
    return _personal(spark, sf).select("extraction_id", scrub.phone(F.col("content")).alias("out"))


def scrub_money(spark: SparkSession, sf: str) -> DataFrame:
    return _personal(spark, sf).select("extraction_id", scrub.money(F.col("content")).alias("out"))


def scrub_date(spark: SparkSession, sf: str) -> DataFrame:
    return _personal(spark, sf).select("extraction_id", scrub.iso_date(F.col("content")).alias("out"))


def scrub_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Mail, telephone, money and date rules in order, the part of the chain that SQL can
    follow; the whole chain is scrub_full."""
    c = F.regexp_replace("content", r"[.](?=[A-Za-z])", ". ")
    return _personal(spark, sf).select("extraction_id", scrub.iso_date(scrub.money(scrub.phone(scrub.email(F.col("content"))))).alias("out"), scrub.residual_secret(c).alias("secret"))


def scrub_full(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain with known slugs and URLs (its look-around has no SQL twin)."""
    return _personal(spark, sf).select("extraction_id", scrub.chain(F.col("content"), ["kelp catalogue", "owl census"]).alias("out"))


def slug_rotation(spark: SparkSession, sf: str) -> DataFrame:
    return _personal(spark, sf).select("extraction_id", scrub.known_slugs(F.col("content"), ["kelp catalogue", "owl census", "heat map"]).alias("out"))


def residual_secret_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with a key of one of the shapes added to every ninth row."""
    keys = ["sk-" + "a" * 24, "ghp_" + "B" * 36, "AIza" + "c" * 35, "xoxb-" + "1" * 22, "sk-short"]
    k = F.element_at(F.array(*map(F.lit, keys)), (F.col("extraction_id") / 9).cast("int") % 5 + 1)
    c = F.when(F.col("extraction_id") % 9 == 0, F.concat("content", F.lit(" "), k)).otherwise(F.col("content"))
    return _personal(spark, sf).select("extraction_id", scrub.residual_secret(c).alias("residual"))


def _personal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "extraction").where("content is not null")


def week_bounds(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    m = dates.last_monday(F.col("ts"))
    return e.select("event_id", F.date_format(m, "yyyy-MM-dd").alias("monday"), F.date_format(F.date_add(m, 6), "yyyy-MM-dd").alias("sunday"))


def week_label_w(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", dates.week_label_w(F.to_date("o_orderdate")).alias("label"))


def week_label_iso(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", dates.week_label_iso(F.to_date("o_orderdate")).alias("label"))


def relative_time(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pipeline_record").select("record_seq", dates.relative_time(instant(F.col("ts")), _now()).alias("rel"))


def deadline_label(spark: SparkSession, sf: str) -> DataFrame:
    due = F.col("received_at") + F.expr("make_dt_interval(cast(record_seq % 90 as int))")
    t = table(spark, sf, "pipeline_record").select("record_seq", dates.deadline_label(due, _now()).alias("d"))
    return t.select("record_seq", "d.label", "d.level")


def confidence_decay(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "index_entry")
    conf = F.element_at(F.array(*map(F.lit, text.CONFIDENCE)), (F.col("entry_id") % 3 + 1).cast("int"))
    return i.select("entry_id", conf.alias("before"), dates.decay(conf, F.col("entry_date").cast("timestamp"), _now()).alias("after"))


def duration_parse(spark: SparkSession, sf: str) -> DataFrame:
    arg = F.concat((F.col("event_id") % 40 - 3).cast("string"), F.element_at(F.array(*map(F.lit, ("h", "d", "w", "", "x", " d", "H"))), (F.col("event_id") % 7 + 1).cast("int")))
    return table(spark, sf, "events").select("event_id", dates.duration_hours(arg).alias("hours"))


QUERIES = {
    f.__name__: f
    for f in (
        slugify, normalize_literal, normalize_life_area, derive_path, drop_id, truncate_snippet, split_tldr, url_slug, raw_path,
        source_meta, url_dispatch, video_id, arxiv_id, safe_url_static, extract_urls, enrich_fanout, attachment_class,
        fallback_ladder, quality_gate, chunk_fixed, html_text_len, conventional_commit, schema_route, index_line_render,
        memory_pointer_format, drop_entry_redacted, calendar_url, note_extract, scrub_email, scrub_phone, scrub_money, scrub_date,
        scrub_chain, scrub_full, slug_rotation, residual_secret_guard, week_bounds, week_label_w, week_label_iso, relative_time,
        deadline_label, confidence_decay, duration_parse,
    )
}


def slug_sql(c: str) -> str:
    return f"substr(coalesce(nullif(trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'untitled'), 1, 50)"


def _pick(values, at: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({at} AS INT)]"


_TAIL = "list_extract(string_split(source_url, '/'), -1)"
_NUM = "lpad(CAST(extraction_id % 100000 AS VARCHAR), 5, '0')"
_VID = f"substr(replace({_TAIL}, '-', '_') || '___________', 1, 11)"
URLS_SQL = f"""u AS (SELECT extraction_id, extracted_at, CASE extraction_id % 12 WHEN 1 THEN 'https://arxiv.org/abs/2301.' || {_NUM} || 'v2'
 WHEN 2 THEN 'https://www.youtube.com/watch?v=' || {_VID} WHEN 3 THEN 'https://youtu.be/' || {_VID} || '?t=3'
 WHEN 4 THEN 'https://github.com/' || {_TAIL} || '/repo' WHEN 5 THEN source_url || '.PDF' WHEN 6 THEN source_url || '/report.docx'
 WHEN 7 THEN 'https://www.instagram.com/p/' || {_TAIL} || '/' WHEN 8 THEN 'https://stackoverflow.com/questions/' || {_NUM} || '/' || {_TAIL}
 WHEN 9 THEN 'http://user@10.0.' || (extraction_id % 256) || '.7:8080/x' WHEN 10 THEN 'http://100.' || (extraction_id % 256) || '.100.200/latest'
 WHEN 11 THEN source_url || '?utm=1#part' ELSE source_url END AS url FROM extraction WHERE source_url IS NOT NULL)"""
_SOCIAL = "regexp_matches(lower({0}), 'instagram[.]com|instagr[.]am|tiktok[.]com')"


def _dispatch(u: str) -> str:
    return f"""CASE WHEN regexp_matches({u}, 'youtube[.]com/watch|youtu[.]be/|youtube[.]com/shorts/') THEN 'youtube'
 WHEN regexp_matches({u}, 'arxiv[.]org/(abs|pdf)/') THEN 'arxiv' WHEN lower({u}) LIKE '%.pdf' THEN 'pdf' WHEN {_SOCIAL.format(u)} THEN 'social'
 WHEN regexp_matches(lower({u}), '[.](docx|xlsx|pptx|doc|xls|ppt)$') THEN 'office' ELSE 'web' END"""


_UTAIL = "trim(regexp_replace(regexp_replace(list_extract(string_split(regexp_replace(url, '/+$', ''), '/'), -1), '[?#].*$', ''), '[^a-zA-Z0-9._-]+', '-', 'g'), '-')"
_USLUG = f"CASE WHEN length({_UTAIL}) BETWEEN 3 AND 50 THEN lower({_UTAIL}) ELSE substr(sha256(url), 1, 8) END"
_HOST = "regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]+$', '')"
_XURL = "https?://[^\\s<>()\\[\\]{}\"'']+[^\\s<>()\\[\\]{}\"''.,;:!?]"
_BODY = "'see ' || url || ', then (' || url || ') and https://a.example/x. or <http://b.example/y>! https://c.example'"
#: First occurrences in order, at most three.
_FIRST3 = "list_slice(list_filter(m, lambda x, i: list_position(m, x) = i), 1, 3)"
_MSG = """CASE o_orderkey % 7 WHEN 0 THEN 'feat: ' WHEN 1 THEN 'fix(core): ' WHEN 2 THEN 'Docs!: ' WHEN 3 THEN 'chore: ' WHEN 4 THEN 'plain '
 WHEN 5 THEN 'perf(api)!: ' ELSE 'refactor : ' END || 'order ' || o_orderkey || ' ' || lower(o_orderpriority)"""
COMMITS_SQL = f"""c AS (SELECT substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 7) AS sha, o_orderkey, lower(c_mktsegment) AS repo,
 strftime(o_orderdate, '%Y-%m-%d') AS day, {_MSG} AS message,
 CASE o_orderkey % 7 WHEN 0 THEN 'feat' WHEN 1 THEN 'fix' WHEN 2 THEN 'docs' WHEN 3 THEN 'chore' WHEN 5 THEN 'perf' ELSE 'other' END AS type,
 CASE WHEN o_orderkey % 7 IN (4, 6) THEN {_MSG} ELSE 'order ' || o_orderkey || ' ' || lower(o_orderpriority) END AS subject,
 o_orderkey % 7 IN (2, 5) OR o_orderkey % 11 = 0 AS breaking FROM orders JOIN customer ON o_custkey = c_custkey)"""
_PERS = "FROM extraction WHERE content IS NOT NULL"
_re = lambda pat, rep, c: f"regexp_replace({c}, '{pat}', '{rep}', 'g')"
_TS = "try_cast(trim(ts) AS TIMESTAMPTZ)"
_AGE = f"(epoch(TIMESTAMPTZ '{CLOCK}+00') - floor(epoch({_TS})))"
_LEFT = f"floor((floor(epoch(received_at)) + (record_seq % 90) * 86400 - epoch(TIMESTAMPTZ '{CLOCK}+00')) / 86400)"
_LOW = "replace(replace(trim(lower(k)), ' ', '_'), '-', '_')"
_KEB = "replace(replace(trim(lower(k)), ' ', '-'), '_', '-')"
_MON = "CAST(ts AS DATE) - CAST(isodow(ts) - 1 + CASE WHEN isodow(ts) = 1 AND hour(ts) < 22 THEN 7 ELSE 0 END AS INT)"
_enc = lambda c: f"replace(replace(replace(replace(url_encode({c}), '%20', '+'), '*', '%2A'), '%7E', '~'), '%2D', '-')"
_pad = lambda c, n: f"rpad({c}, CAST(greatest({n}, length({c})) AS INT), ' ')"
_SOURCE_TAGS = "array_to_string(list_transform(list_slice(coalesce(tags, []), 1, 5), lambda t: '#' || t), ' ')"

SQL = {
    "slugify": f"SELECT doc_id, {slug_sql('text')} AS slug FROM documents",
    "normalize_literal": f"""SELECT record_seq, CASE WHEN k IN {text.KINDS} THEN k WHEN {_LOW} IN {text.KINDS} THEN {_LOW} WHEN {_KEB} IN {text.KINDS} THEN {_KEB}
 ELSE coalesce({', '.join(f"CASE WHEN starts_with({_LOW}, '{a}') OR starts_with('{a}', {_LOW}) THEN '{a}' END" for a in text.KINDS)}, 'daily_only') END AS kind
 FROM (SELECT record_seq, coalesce(target_kind, '') AS k FROM pipeline_record)""",
    "normalize_life_area": f"""WITH a AS (SELECT list(life_category ORDER BY life_category) AS areas FROM life_category),
c AS (SELECT DISTINCT classification_id, life_area, {slug_sql('life_area')} AS s FROM classification WHERE life_area IS NOT NULL)
SELECT classification_id, life_area, CASE WHEN life_area = '' THEN NULL WHEN list_contains(areas, life_area) THEN life_area WHEN list_contains(areas, s) THEN s
 ELSE list_extract(list_filter(areas, lambda x: starts_with(s, x) OR starts_with(x, s)), 1) END AS area FROM c, a""",
    "derive_path": f"""SELECT DISTINCT classification_id, target_kind, slug, life_area, CASE target_kind WHEN 'project' THEN 'projects/' || {slug_sql('slug')} || '.md'
 WHEN 'life' THEN CASE WHEN length(life_area) > 0 THEN 'life/' || {slug_sql('life_area')} || '.md' ELSE '' END WHEN 'wiki' THEN 'wiki/' || {slug_sql('slug')} || '.md'
 WHEN 'credential' THEN 'life/credentials/' || {slug_sql('slug')} || '.md' ELSE '' END AS path FROM classification""",
    "drop_id": "SELECT doc_id, substr(sha256(text), 1, 12) AS drop_id FROM documents WHERE text IS NOT NULL",
    "truncate_snippet": "SELECT doc_id, CASE WHEN length(text) > 2000 THEN regexp_replace(substr(text, 1, 2000), '[\\s\\p{Z}]+$', '') || '…' ELSE text END AS snippet FROM documents",
    "split_tldr": """WITH e AS (SELECT extraction_id, trim(concat_ws('. ', title, summary)) AS s FROM extraction WHERE summary IS NOT NULL),
p AS (SELECT *, length(regexp_extract(s, '^(.*?[.?!])\\s', 1)) AS n FROM e)
SELECT extraction_id, CASE WHEN n > 0 THEN trim(substr(s, 1, n)) ELSE s END AS tldr, CASE WHEN n > 0 THEN trim(substr(s, n + 1)) ELSE '' END AS rest FROM p""",
    "url_slug": f"WITH {URLS_SQL} SELECT extraction_id, url, {_USLUG} AS slug FROM u",
    "raw_path": f"WITH {URLS_SQL} SELECT extraction_id, 'raw/' || strftime(extracted_at AT TIME ZONE 'UTC', '%Y-%m-%d') || '-' || {_dispatch('url')} || '-' || {_USLUG} || '.md' AS path FROM u",
    "source_meta": f"""WITH {URLS_SQL} SELECT extraction_id, CASE WHEN lower(url) LIKE '%arxiv.org%' THEN 'paper' WHEN lower(url) LIKE '%github.com%' THEN 'code'
 WHEN lower(url) LIKE '%youtube.com%' OR lower(url) LIKE '%youtu.be%' THEN 'video' WHEN lower(url) LIKE '%stackoverflow.com%' OR lower(url) LIKE '%stackexchange.com%' THEN 'discussion'
 WHEN lower(url) LIKE '%.pdf' OR lower(url) LIKE '%/pdf/%' THEN 'pdf' ELSE 'web' END AS source_type,
 lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS domain FROM u""",
    "url_dispatch": f"WITH {URLS_SQL} SELECT extraction_id, {_dispatch('url')} AS extractor, regexp_replace(url, '[?#].*$', '') AS clean FROM u",
    "video_id": f"WITH {URLS_SQL} SELECT * FROM (SELECT extraction_id, nullif(regexp_extract(url, '(?:youtube[.]com/watch[?]v=|youtu[.]be/|youtube[.]com/shorts/)([A-Za-z0-9_-]{{11}})', 1), '') AS video_id FROM u) WHERE video_id IS NOT NULL",
    "arxiv_id": f"WITH {URLS_SQL} SELECT * FROM (SELECT extraction_id, nullif(regexp_extract(url, 'arxiv[.]org/(?:abs|pdf)/([a-z-]+/[0-9]{{7}}|[0-9]{{4}}[.][0-9]{{4,5}})', 1), '') AS arxiv_id FROM u) WHERE arxiv_id IS NOT NULL",
    "safe_url_static": f"""WITH {URLS_SQL}, h AS (SELECT extraction_id, url, {_HOST} AS host FROM u),
o AS (SELECT *, regexp_full_match(host, '[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}') AS quad, try_cast(split_part(host, '.', 1) AS INT) AS a, try_cast(split_part(host, '.', 2) AS INT) AS b FROM h)
SELECT extraction_id, CASE WHEN NOT regexp_matches(url, '^https?:') THEN 'scheme_not_allowed' WHEN host = '' THEN 'no_hostname'
 WHEN quad AND (a IN (0, 10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR a >= 224) THEN 'private_ip'
 WHEN quad AND a = 100 AND b BETWEEN 64 AND 127 THEN 'blocked_net' ELSE 'ok' END AS verdict FROM o""",
    "extract_urls": f"""WITH {URLS_SQL}, x AS (SELECT extraction_id, regexp_extract_all({_BODY}, '{_XURL}') AS m FROM u)
SELECT extraction_id, array_to_string({_FIRST3}, ' ') AS urls FROM x""",
    "enrich_fanout": f"""WITH {URLS_SQL}, x AS (SELECT extraction_id, regexp_extract_all(url || ' https://youtu.be/abcdefghijk https://notes.example/a.pdf', '{_XURL}') AS m FROM u),
e AS (SELECT extraction_id, unnest({_FIRST3}) AS one, generate_subscripts({_FIRST3}, 1) AS i FROM x)
SELECT extraction_id, string_agg({_dispatch('one')}, '+' ORDER BY i) AS extractors FROM e GROUP BY extraction_id""",
    "attachment_class": "SELECT doc_id, " + _pick(["text", "pdf", "hwp", "office", "text", "image", "office"], "doc_id % 7 + 1") + ' AS "class" FROM documents',
    "fallback_ladder": """SELECT extraction_id, CASE WHEN length(content) >= 200 THEN 'tier1' WHEN length(content) >= 100 THEN 'tier2' WHEN length(summary) >= 60 THEN 'summary' ELSE 'none' END AS tier FROM extraction""",
    "quality_gate": """SELECT doc_id, length(t) >= 100 AND 1 - (length(t) - length(regexp_replace(t, '[\\x00-\\x1F\\x7F]', '', 'g'))) / greatest(length(t), 1) >= 0.85 AS ok
 FROM (SELECT doc_id, regexp_replace(text, '[\\r\\n]', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL)""",
    "chunk_fixed": """WITH d AS (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 3800) AS INT))) AS part FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(part AS INT) AS part, CAST(length(substr(text, part * 3800 + 1, 3800)) AS INT) AS chars, md5(substr(text, part * 3800 + 1, 3800)) AS digest FROM d""",
    "html_text_len": "SELECT doc_id, CAST(length(regexp_replace(text, '<[^>]*>', '', 'g')) AS INT) AS chars FROM documents WHERE text IS NOT NULL",
    "conventional_commit": f"WITH {COMMITS_SQL} SELECT sha, type, subject, breaking FROM c",
    "schema_route": "SELECT record_seq, CASE target_kind WHEN 'life' THEN 'life_entry' WHEN 'credential' THEN 'credential_entry' ELSE CASE drop_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.SCHEMA_OF_TYPE.items())
    + " ELSE 'personal_log' END END AS schema FROM pipeline_record",
    "index_line_render": f"""SELECT entry_id, '- [[' || slug || ']] — ' || trim(replace(substr(coalesce(nullif(summary, ''), slug), 1, 60), chr(10), ' ')) || ' [' || {_SOURCE_TAGS}
 || '] (' || strftime(entry_date, '%Y-%m-%d') || ')' AS line FROM index_entry WHERE entry_date IS NOT NULL""",
    "memory_pointer_format": f"""SELECT record_seq, {_pad("replace(list_extract(string_split(target_path, '/'), -1), '.md', '')", 20)} || ' ' || {_pad('target_path', 45)} || ' ' ||
 {_pad('substr(slug, 1, 60)', 60)} || ' [' || target_confidence || ']' AS line FROM pipeline_record WHERE target_kind IN ('project', 'wiki') AND target_path IS NOT NULL AND target_confidence IS NOT NULL""",
    "drop_entry_redacted": """SELECT record_seq, '## ' || strftime(received_at AT TIME ZONE 'UTC', '%H:%M') || chr(10) || CASE WHEN target_kind = 'credential' THEN '**credential** → (redacted)' || chr(10)
 ELSE '**' || drop_type || '** → `' || coalesce(nullif(target_path, ''), 'daily_only') || '`' || chr(10) || coalesce(slug, '') || chr(10) END AS entry FROM pipeline_record WHERE received_at IS NOT NULL""",
    "calendar_url": f"""SELECT extraction_id, '{CALENDAR}?action=TEMPLATE&text=' || {_enc('title')} || '&dates=' || d || '%2F' || d || '&details=' || {_enc("summary || ' ~*+é&'")} AS url
 FROM (SELECT *, strftime(extracted_at AT TIME ZONE 'UTC', '%Y%m%d') || 'T000000Z' AS d FROM extraction WHERE title IS NOT NULL AND summary IS NOT NULL)""",
    "note_extract": """SELECT extraction_id, trim(summary) AS note, CASE WHEN extraction_id % 5 = 0 THEN trim(coalesce(title, '?')) END AS blocker FROM extraction WHERE summary IS NOT NULL""",
    "scrub_email": "SELECT extraction_id, " + _re(scrub.EMAIL_RE, "user@example.com", "content") + f" AS out {_PERS}",
    "scrub_phone": "SELECT extraction_id, " + _re(scrub.PHONE_RE, scrub.PHONE_TO, "content") + f" AS out {_PERS}",
    "scrub_money": "SELECT extraction_id, " + _re(scrub.MONEY_RE, scrub.MONEY_TO, "content") + f" AS out {_PERS}",
    "scrub_date": "SELECT extraction_id, " + _re(scrub.DATE_RE, scrub.DATE_TO, "content") + f" AS out {_PERS}",
    "scrub_chain": "SELECT extraction_id, "
    + _re(scrub.DATE_RE, scrub.DATE_TO, _re(scrub.MONEY_RE, scrub.MONEY_TO, _re(scrub.PHONE_RE, scrub.PHONE_TO, _re(scrub.EMAIL_RE, "user@example.com", "content"))))
    + f" AS out, FALSE AS secret {_PERS}",
    "slug_rotation": "SELECT extraction_id, "
    + "regexp_replace(regexp_replace(regexp_replace(content, '\\bkelp catalogue\\b', 'project-a', 'gi'), '\\bowl census\\b', 'project-b', 'gi'), '\\bheat map\\b', 'project-c', 'gi')"
    + f" AS out {_PERS}",
    "residual_secret_guard": f"SELECT extraction_id, extraction_id % 9 = 0 AND (extraction_id // 9) % 5 <> 4 AS residual {_PERS}",
    "week_bounds": f"SELECT event_id, strftime({_MON}, '%Y-%m-%d') AS monday, strftime({_MON} + 6, '%Y-%m-%d') AS sunday FROM events",
    "week_label_w": "SELECT o_orderkey, strftime(o_orderdate, '%Y-W%W') AS label FROM orders",
    "week_label_iso": "SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS label FROM orders",
    "relative_time": f"""SELECT record_seq, CASE WHEN {_TS} IS NULL THEN '—' WHEN {_AGE} < 60 THEN 'just now' WHEN {_AGE} < 3600 THEN CAST(floor({_AGE} / 60) AS INT) || 'm ago'
 WHEN {_AGE} < 86400 THEN CAST(floor({_AGE} / 3600) AS INT) || 'h ago' WHEN {_AGE} < 172800 THEN 'yesterday' WHEN {_AGE} < 2592000 THEN CAST(floor({_AGE} / 86400) AS INT) || 'd ago'
 ELSE strftime({_TS} AT TIME ZONE 'UTC', '%Y-%m-%d') END AS rel FROM pipeline_record""",
    "deadline_label": f"""SELECT record_seq, CASE WHEN n IS NULL THEN '—' WHEN n < 0 THEN 'overdue ' || (-n) || 'd' ELSE '+' || n || 'd' END AS label,
 CASE WHEN n IS NULL THEN 'ok' WHEN n <= 7 THEN 'urgent' WHEN n <= 30 THEN 'warn' ELSE 'ok' END AS level FROM (SELECT record_seq, CAST({_LEFT} AS INT) AS n FROM pipeline_record)""",
    "confidence_decay": """SELECT entry_id, c AS before, CASE WHEN c = 'high' AND d > 30 THEN 'medium' WHEN c = 'medium' AND d > 90 THEN 'low' ELSE c END AS after
 FROM (SELECT entry_id, ['high', 'medium', 'low'][CAST(entry_id % 3 + 1 AS INT)] AS c, DATE '2024-01-31' - entry_date AS d FROM index_entry)""",
    "duration_parse": """WITH a AS (SELECT event_id, event_id % 40 - 3 AS n, event_id % 7 AS k FROM events),
h AS (SELECT *, n * CASE k WHEN 1 THEN 24 WHEN 2 THEN 168 ELSE 1 END AS h FROM a) SELECT event_id, CAST(CASE WHEN k <> 4 AND h >= 1 THEN h ELSE 24 END AS BIGINT) AS hours FROM h""",
}
