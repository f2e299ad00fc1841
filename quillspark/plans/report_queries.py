"""Bindings of page rewriting, context joins and composed reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import scrub, text
from quillspark.operators import evals, pages
from quillspark.plans import scalar_queries
from quillspark.plans.page_queries import _V, _pages
from quillspark.sources import vault
from quillspark.sources.tables import table


def chunk_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("length(text) > 0").select("doc_id", F.posexplode(text.pack_paragraphs(F.regexp_replace("text", "\r", ""), 3800)).alias("part", "chunk"))
    return d.select("doc_id", "part", F.length("chunk").alias("chars"))


def token_shape(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pipeline_record").select("record_seq", text.token_shaped(F.col("drop_id")).alias("ok"))


def strip_file_date(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "harvested_fixture")
    name = F.when(F.col("fixture_no") % 2 == 0, F.concat("source_harvest_id", F.lit("-"), "category", F.lit(".md"))).otherwise(F.concat("category", F.lit("_"), "source_harvest_id", F.lit(".md")))
    return h.select("fixture_no", text.strip_file_date(name).alias("name"))


def summary_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "extraction").select("extraction_id", text.summary_of(*map(F.col, ("kind", "title", "summary", "content"))).alias("summary"))


def page_render(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "extraction")
    return e.select("extraction_id", F.md5(text.render_page(*map(F.col, ("kind", "title", "context", "summary", "content", "key_claims")))).alias("digest"))


def hashtags(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "index_entry").where("tags is not null")
    line = F.concat_ws(" ", F.transform("tags", lambda t: F.concat(F.lit("#"), F.regexp_replace(t, "[^A-Za-z0-9]", ""))))
    return i.select("entry_id", F.concat_ws("|", text.hashtags(line)).alias("tags"))


def section_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    p = _pages(spark, sf).where(F.col("path").startswith("wiki/"))
    return p.select("path", F.md5(pages.replace_section(F.col("content"), "## Related", F.lit("- none"))).alias("digest"))


def project_move(spark: SparkSession, sf: str) -> DataFrame:
    p = _pages(spark, sf).where(F.col("path").startswith("projects/")).withColumn("content", F.concat(F.lit("---\nstatus: active\nstatus: old\n---\n"), "content"))
    return pages.move_page(p, "projects/", "projects/archive/", "done").select("path", F.md5("content").alias("digest"))


def context_attach(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "pipeline_record").select("record_seq", "slug")
    return pages.with_context(t, table(spark, sf, "index_entry")).select("record_seq", F.coalesce("page_summary", F.lit("")).alias("page_summary"))


def drop_text_join(spark: SparkSession, sf: str) -> DataFrame:
    """Text of a run's drop by day and drop_id."""
    t = table(spark, sf, "pipeline_record").select("record_seq", "drop_id", F.to_date("received_at").alias("day"))
    e = table(spark, sf, "extraction").where("drop_id is not null and coalesce(content, summary) is not null").select("drop_id", F.to_date("extracted_at").alias("day"), F.coalesce("content", "summary").alias("body"), "extraction_id")
    first = e.groupBy("drop_id", "day").agg(F.min_by("body", "extraction_id").alias("body"))  # one text per key, so a hot drop does not multiply
    return t.join(first, ["drop_id", "day"]).select("record_seq", F.length("body").alias("chars"))


def memory_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Newest pointer line of every page."""
    t = table(spark, sf, "pipeline_record").where("target_kind in ('project', 'wiki') and target_path is not null and target_confidence is not null").select("target_path", "record_seq", "slug", "target_confidence")
    return pages.latest(t, "target_path", "record_seq").select(F.col("target_path").alias("path"), text.memory_line(F.col("target_path"), F.col("slug"), F.col("target_confidence")).alias("line"))


def tier_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of a map column by key; stage times stand in, as the usage map is never filled."""
    t = table(spark, sf, "pipeline_record").where("provider is not null").select("provider", F.explode("stage_latency_ms").alias("tier", "used"))
    return t.groupBy("provider", "tier").agg(F.sum(F.col("used").cast("long")).alias("used"), F.count("*").alias("calls"))


def cassette_key(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "eval_fixture").select("id", F.lit("classifier").alias("agent"), F.lit("small").alias("model"), F.col("input.text").alias("prompt"), F.lit(0.3).alias("temperature"))
    return evals.with_keys(r).select("id", "prompt_hash")


def scrub_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each text the scrubbing keeps."""
    e = table(spark, sf, "extraction").where("content is not null").select("extraction_id", "content", scrub.chain(F.col("content")).alias("out"))
    return evals.similarity(e, "content", "out").select("extraction_id", F.round("similarity", 6).alias("similarity"))


def harvest_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """Runs not harvested yet, with their text scrubbed; texts with a key left, or changed
    beyond half, are skipped."""
    fresh = evals.fresh(table(spark, sf, "pipeline_record").where("drop_id is not null").select("record_seq", "drop_id"), table(spark, sf, "harvested_fixture").select(F.col("source_drop_id").alias("drop_id")), "drop_id")
    body = table(spark, sf, "extraction").where("content is not null and drop_id is not null").groupBy("drop_id").agg(F.min_by("content", "extraction_id").alias("content"))
    x = fresh.groupBy("drop_id").agg(F.min("record_seq").alias("record_seq")).join(body, "drop_id").withColumn("out", scrub.chain(F.col("content")))
    kept = x.where(~scrub.residual_secret(F.col("content")) & ~scrub.residual_secret(F.col("out")))
    return evals.similarity(kept, "content", "out").where("similarity >= 0.5").select("record_seq", "drop_id", "out")


def brief_context(spark: SparkSession, sf: str) -> DataFrame:
    """Yesterday's context per source: commits, new index rows and life entries, ten lines each."""
    day = "2024-01-30"
    i = table(spark, sf, "index_entry").where(F.col("entry_date") == day).select(F.lit("index").alias("source"), "slug", F.col("entry_id").alias("k"))
    life = table(spark, sf, "extraction").where((F.col("kind") == "life_entry") & (F.to_date("extracted_at") == day)).select(F.lit("life").alias("source"), F.coalesce("title", F.lit("untitled")).alias("slug"), F.col("extraction_id").alias("k"))
    runs = table(spark, sf, "pipeline_record").where((F.to_date("received_at") == day) & F.col("slug").isNotNull()).select(F.lit("run").alias("source"), "slug", F.col("record_seq").alias("k"))
    tops = [d.orderBy("k").limit(10) for d in (i, life, runs)]
    return tops[0].unionByName(tops[1]).unionByName(tops[2]).select("source", "slug", "k")


def set_union_block_list(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted union of fixed and configured block prefixes of every configuration."""
    v = table(spark, sf, "vault_config").select(F.explode("never_read_paths").alias("prefix"))
    return v.where("prefix is not null").union(spark.createDataFrame([(p,) for p in vault.ALWAYS_BLOCKED], "prefix string")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        chunk_paragraphs, token_shape, strip_file_date, summary_of, page_render, hashtags, section_rewrite, project_move, context_attach,
        drop_text_join, memory_upsert, tier_usage, cassette_key, scrub_similarity, harvest_cycle, brief_context, set_union_block_list,
    )
}
_NL = "chr(10)"
_POINTS = "nullif(array_to_string(list_transform(coalesce(key_claims, []), lambda x: '- ' || x), chr(10)), '')"
_DAY = lambda c: f"CAST({c} AT TIME ZONE 'UTC' AS DATE)"

SQL = {
    "token_shape": "SELECT record_seq, coalesce(regexp_full_match(drop_id, '[A-Za-z0-9_-]{8,64}'), FALSE) AS ok FROM pipeline_record",
    "strip_file_date": "SELECT fixture_no, category || '.md' AS name FROM harvested_fixture",
    "summary_of": """SELECT extraction_id, substr(coalesce(CASE WHEN kind IN ('concept_drop', 'life_entry') THEN title WHEN kind IN ('project_update', 'query_intent') THEN summary
 WHEN kind = 'personal_log' THEN content END, ''), 1, 60) AS summary FROM extraction""",
    "page_render": f"""SELECT extraction_id, md5(CASE WHEN kind = 'credential_entry' THEN '# ' || coalesce(title, 'untitled') ELSE concat_ws({_NL} || {_NL}, '# ' || coalesce(title, 'untitled'),
 nullif(summary, ''), nullif(content, ''), {_POINTS}, CASE WHEN length(context) > 0 THEN '_Context: ' || context || '_' END) END) AS digest FROM extraction""",
    "hashtags": """SELECT entry_id, array_to_string(list_filter(list_transform(tags, lambda t: regexp_replace(t, '[^A-Za-z0-9]', '', 'g')), lambda t: t <> ''), '|') AS tags FROM index_entry WHERE tags IS NOT NULL""",
    "section_rewrite": f"""{_V} SELECT path, md5(regexp_replace(content, '## Related\\n- [^\\n]*\\n', '## Related' || {_NL} || '- none' || {_NL})) AS digest FROM wiki""",
    "project_move": f"""{_V} SELECT 'projects/archive/' || substr(path, 10) AS path, md5('---' || {_NL} || 'status: done' || {_NL} || 'status: old' || {_NL} || '---' || {_NL} || content) AS digest
 FROM v WHERE starts_with(path, 'projects/')""",
    "context_attach": """WITH i AS (SELECT slug, summary FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY entry_date DESC NULLS LAST, entry_id DESC) AS r FROM index_entry) WHERE r = 1)
SELECT record_seq, coalesce(i.summary, '') AS page_summary FROM pipeline_record p LEFT JOIN i ON i.slug = p.slug""",
    "drop_text_join": f"""WITH e AS (SELECT drop_id, {_DAY('extracted_at')} AS day, arg_min(coalesce(content, summary), extraction_id) AS body FROM extraction
 WHERE drop_id IS NOT NULL AND coalesce(content, summary) IS NOT NULL GROUP BY ALL)
SELECT record_seq, CAST(length(body) AS INT) AS chars FROM pipeline_record p JOIN e ON e.drop_id = p.drop_id AND e.day = {_DAY('p.received_at')}""",
    "memory_upsert": scalar_queries.SQL["memory_pointer_format"].replace("SELECT record_seq,", "SELECT target_path AS path,").replace(
        "FROM pipeline_record WHERE", "FROM (SELECT * FROM pipeline_record QUALIFY row_number() OVER (PARTITION BY target_path, target_kind IN ('project', 'wiki') AND target_confidence IS NOT NULL ORDER BY record_seq DESC) = 1) WHERE"
    ),
    "tier_usage": """SELECT provider, e.key AS tier, CAST(sum(CAST(trunc(e.value) AS BIGINT)) AS BIGINT) AS used, count(*) AS calls
 FROM (SELECT provider, unnest(map_entries(stage_latency_ms)) AS e FROM pipeline_record WHERE provider IS NOT NULL) GROUP BY ALL""",
    "brief_context": f"""(SELECT 'index' AS source, slug, entry_id AS k FROM index_entry WHERE entry_date = DATE '2024-01-30' ORDER BY k LIMIT 10)
UNION ALL (SELECT 'life', coalesce(title, 'untitled'), extraction_id AS k FROM extraction WHERE kind = 'life_entry' AND {_DAY('extracted_at')} = DATE '2024-01-30' ORDER BY k LIMIT 10)
UNION ALL (SELECT 'run', slug, record_seq AS k FROM pipeline_record WHERE {_DAY('received_at')} = DATE '2024-01-30' AND slug IS NOT NULL ORDER BY k LIMIT 10)""",
    "set_union_block_list": "SELECT DISTINCT prefix FROM (SELECT unnest(never_read_paths) AS prefix FROM vault_config UNION ALL SELECT 'life/credentials/') WHERE prefix IS NOT NULL",
}
