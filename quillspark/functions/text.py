"""Column functions over names, paths and rendered lines. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed sets of the data model.
KINDS = ("project", "life", "wiki", "credential", "daily_only")
DROP_TYPES = ("task", "deadline", "technical_link", "paper", "personal_thought", "life_item", "credential", "query", "ambiguous")
CONFIDENCE = ("high", "medium", "low")
COMMIT_TYPES = ("feat", "fix", "perf", "refactor", "test", "docs", "build", "ci", "chore", "style", "revert", "other")
SNIPPET_CHARS, SUMMARY_CHARS, SLUG_CHARS = 2000, 60, 50
# Fixed value: the extraction schema of each drop type; the target kind comes first.
SCHEMA_OF_TYPE = {
    "task": "project_update", "deadline": "project_update", "technical_link": "concept_drop", "paper": "concept_drop",
    "personal_thought": "personal_log", "life_item": "life_entry", "credential": "credential_entry", "query": "query_intent",
    "ambiguous": "personal_log",
}
SCHEMA_OF_KIND = {"life": "life_entry", "credential": "credential_entry"}


def slugify(c: Column) -> Column:
    s = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.substring(F.coalesce(F.nullif(s, F.lit("")), F.lit("untitled")), 1, SLUG_CHARS)


def _first_prefix(c: Column, allowed: Sequence[str]) -> Column:
    return F.coalesce(*(F.when(c.startswith(a) | F.startswith(F.lit(a), c), F.lit(a)) for a in allowed))


def normalize_literal(c: Column, allowed: Sequence[str], default: str) -> Column:
    """Nearest allowed value: exact, snake case, kebab case, mutual prefix. An empty value
    is a prefix of everything and so gives the first allowed one."""
    low = F.trim(F.lower(c))
    snake = F.replace(F.replace(low, F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))
    kebab = F.replace(F.replace(low, F.lit(" "), F.lit("-")), F.lit("_"), F.lit("-"))
    return (
        F.when(c.isin(*allowed), c)
        .when(snake.isin(*allowed), snake)
        .when(kebab.isin(*allowed), kebab)
        .otherwise(F.coalesce(_first_prefix(snake, allowed), F.lit(default)))
    )


def life_area(c: Column, allowed: Column) -> Column:
    """Area of an allowed list: exact, slug, mutual prefix, else null; null and empty give null."""
    s = slugify(c)
    near = F.filter(allowed, lambda a: s.startswith(a) | a.startswith(s))
    return F.when(F.length(c) > 0, F.when(F.array_contains(allowed, c), c).when(F.array_contains(allowed, s), s).otherwise(F.try_element_at(near, F.lit(1))))


def derive_path(kind: Column, slug: Column, area: Column) -> Column:
    """Canonical page of a classified drop; '' where there is none."""
    s = slugify(slug)
    return (
        F.when(kind == "project", F.concat(F.lit("projects/"), s, F.lit(".md")))
        .when(kind == "life", F.when(F.length(area) > 0, F.concat(F.lit("life/"), slugify(area), F.lit(".md"))).otherwise(""))
        .when(kind == "wiki", F.concat(F.lit("wiki/"), s, F.lit(".md")))
        .when(kind == "credential", F.concat(F.lit("life/credentials/"), s, F.lit(".md")))
        .otherwise("")
    )


def drop_id(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def snippet(c: Column, limit: int = SNIPPET_CHARS) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.regexp_replace(F.substring(c, 1, limit), r"(?U)\s+\z", ""), F.lit("…"))).otherwise(c)


#: Fixed value: what follows a text that was cut.
CUT_NOTICE = "…\n[truncated — full text in raw/]"


def pipeline_snippet(text: Column, url: Column, source: Column, limit: int = SNIPPET_CHARS) -> Column:
    """What is added to a drop for a URL in it: a header that names it, then the text without
    outer white space, cut at `limit` with a notice."""
    t = F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")
    cut = F.concat(F.regexp_replace(F.substring(t, 1, limit), r"(?U)\s+\z", ""), F.lit(CUT_NOTICE))
    return F.concat(F.lit("\n\n[Extracted from "), url, F.lit(" ("), source, F.lit(")]\n"), F.when(F.length(t) > limit, cut).otherwise(t))


#: Facts of a source in the order in which its raw page lists them.
RAW_FACTS = ("authors", "channel", "duration", "upload_date", "published", "citations", "categories")


def raw_markdown(text: Column, title: Column, source: Column, url: Column, extracted: Column, method: Column, warning: Column, facts: Column) -> Column:
    """Full page of the raw tier: title, source lines, the known facts that are there (a map
    of text), then the whole text, never cut."""
    line = lambda k, v: F.concat(F.lit(f"- {k}: "), v)
    head = [F.concat(F.lit("# "), F.coalesce(F.nullif(title, F.lit("")), url)), F.lit(""), line("Source", source), line("URL", url), line("Extracted", extracted), line("Method", method)]
    noted = F.when(F.length(warning) > 0, line("Warning", warning))
    known = [line(k, F.try_element_at(facts, F.lit(k))) for k in RAW_FACTS]
    return F.concat_ws("\n", *head, noted, F.lit(""), *known, F.lit(""), F.lit("---"), F.lit(""), text)


def split_tldr(c: Column) -> Column:
    """Struct (tldr, rest): the first sentence and what follows it."""
    s = F.trim(F.coalesce(c, F.lit("")))
    at = F.regexp_instr(s, F.lit(r"[.?!]\s"))
    return F.when(at > 0, F.struct(F.trim(F.substr(s, F.lit(1), at)).alias("tldr"), F.trim(F.substr(s, at + 1)).alias("rest"))).otherwise(F.struct(s.alias("tldr"), F.lit("").alias("rest")))


# The first line of a conventional commit, and the heading of each type in a digest.
COMMIT_LABELS = {
    "feat": "Features", "fix": "Fixes", "perf": "Performance", "refactor": "Refactors", "test": "Tests", "docs": "Docs",
    "build": "Build", "ci": "CI", "chore": "Chores", "style": "Style", "revert": "Reverts", "other": "Other",
}
COMMIT_RE = r"(?i)^(feat|fix|docs|chore|refactor|test|style|perf|build|ci|revert)(\([^)]*\))?(!)?:\s*(.+)$"


def conventional_commit(first_line: Column, body: Column) -> Column:
    """Struct (type, subject, breaking); a footer in the body also breaks."""
    hit = first_line.rlike(COMMIT_RE)
    part = lambda i: F.regexp_extract(first_line, COMMIT_RE, i)
    footer = F.contains(F.upper(F.coalesce(body, F.lit(""))), F.lit("BREAKING CHANGE"))
    return F.struct(
        F.when(hit, F.lower(part(1))).otherwise("other").alias("type"),
        F.when(hit, part(4)).otherwise(first_line).alias("subject"),
        ((hit & (part(3) == "!")) | footer).alias("breaking"),
    )


def first_prose_line(body: Column) -> Column:
    """First line that is neither blank nor a heading, trimmed; null if none."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(x))
    return F.try_element_at(F.filter(lines, lambda x: (x != "") & ~x.startswith("#")), F.lit(1))


def first_paragraph(body: Column) -> Column:
    """First paragraph that is not a heading, trimmed; null if none."""
    paras = F.transform(F.split(body, "\n\n"), lambda x: F.trim(x))
    return F.try_element_at(F.filter(paras, lambda x: (x != "") & ~x.startswith("#")), F.lit(1))


def blocker(header: Column, body: Column) -> Column:
    """Blocker named in the page header, else in a line of its body; null if none."""
    h = F.nullif(F.trim(F.regexp_extract(header, r"(?m)^blocker:[ \t]*(.*)$", 1)), F.lit(""))
    b = F.nullif(F.trim(F.regexp_extract(body, r"(?im)^[-* ]*blocke(?:r|d by):[ \t]*(.*)$", 1)), F.lit(""))
    return F.coalesce(h, b)


def index_line(slug: Column, summary: Column, tags: Column, day: Column) -> Column:
    text = F.trim(F.replace(F.substring(F.coalesce(F.nullif(summary, F.lit("")), slug), 1, SUMMARY_CHARS), F.lit("\n"), F.lit(" ")))
    marks = F.concat_ws(" ", F.transform(F.slice(F.coalesce(tags, F.array().cast("array<string>")), 1, 5), lambda t: F.concat(F.lit("#"), t)))
    return F.concat(F.lit("- [["), slug, F.lit("]] — "), text, F.lit(" ["), marks, F.lit("] ("), day, F.lit(")"))


def pad(c: Column, width: int) -> Column:
    """Padded on the right, never cut."""
    return F.rpad(c, F.greatest(F.lit(width), F.length(c)), F.lit(" "))


def memory_line(path: Column, summary: Column, confidence: Column) -> Column:
    name = F.replace(F.element_at(F.split(path, "/"), -1), F.lit(".md"), F.lit(""))
    return F.concat_ws(" ", pad(name, 20), pad(path, 45), pad(F.substring(summary, 1, SUMMARY_CHARS), 60), F.concat(F.lit("["), confidence, F.lit("]")))


def drop_entry(time: Column, kind: Column, drop_kind: Column, path: Column, summary: Column) -> Column:
    """Log entry of one drop; a credential shows neither place nor content."""
    head = F.concat(F.lit("## "), time, F.lit("\n"))
    dest = F.coalesce(F.nullif(path, F.lit("")), F.lit("daily_only"))
    return F.when(kind == "credential", F.concat(head, F.lit("**credential** → (redacted)\n"))).otherwise(
        F.concat(head, F.lit("**"), drop_kind, F.lit("** → `"), dest, F.lit("`\n"), F.coalesce(summary, F.lit("")), F.lit("\n"))
    )


def form_encode(c: Column) -> Column:
    """application/x-www-form-urlencoded with ~ kept and * escaped."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def calendar_url(base: str, title: Column, start: Column, end: Column, details: Column, place: Column, most: int = 2000) -> Column:
    """Add-event link; details are cut so that the link stays within `most` characters."""
    def stamp(c: Column) -> Column:
        bare = F.regexp_replace(c, "-", "")
        return F.when((F.length(c) == 10) & ~F.contains(c, F.lit("T")), F.concat(bare, F.lit("T000000Z"))).otherwise(F.concat(F.regexp_replace(bare, "[:Z]", ""), F.lit("Z")))

    def link(d: Column) -> Column:
        parts = [("action", F.lit("TEMPLATE")), ("text", title), ("dates", F.concat(stamp(start), F.lit("/"), stamp(F.coalesce(end, start)))), ("details", d), ("location", place)]
        return F.concat(F.lit(base + "?"), F.concat_ws("&", *(F.when(F.length(v) > 0, F.concat(F.lit(k + "="), form_encode(v))) for k, v in parts)))

    full = link(details)
    room = F.lit(most - 10) - F.length(full) + F.length(form_encode(details))
    return F.when((F.length(full) > most) & (room > 0), link(F.concat(F.substr(details, F.lit(1), room), F.lit("…")))).otherwise(full)


def html_text(c: Column) -> Column:
    """Readable text of a page: scripts, styles, comments and tags become blanks, the common
    entities characters; runs of blanks and of empty lines are joined, the ends trimmed."""
    for gone in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->", r"(?s)<[A-Za-z/!][^>]*>"):
        c = F.regexp_replace(c, gone, " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def chunks(c: Column, size: int) -> Column:
    """Fixed-size slices that join to the whole."""
    n = F.greatest(F.lit(1), F.ceil(F.length(c) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(c, i * size + 1, F.lit(size)))


def printable_ok(c: Column, least: int = 100, share: float = 0.85) -> Column:
    """Long enough and mostly printable (controls and private code points are not)."""
    bad = F.length(c) - F.length(F.regexp_replace(c, r"[\x00-\x1F\x7F]", ""))
    return (F.length(c) >= least) & (1 - bad / F.greatest(F.length(c), F.lit(1)) >= share)


def ladder(*tiers: tuple[Column, int, str], default: str = "none") -> Column:
    """Name of the first extraction tier (text, least characters, name) that is long enough."""
    return F.coalesce(*(F.when(F.length(c) >= least, name) for c, least, name in tiers), F.lit(default))


def schema_route(kind: Column, drop_type: Column) -> Column:
    case = F.lit("personal_log")
    for k, v in reversed(SCHEMA_OF_TYPE.items()):
        case = F.when(drop_type == k, v).otherwise(case)
    for k, v in reversed(SCHEMA_OF_KIND.items()):
        case = F.when(kind == k, v).otherwise(case)
    return case


def hashtags(c: Column, most: int = 30) -> Column:
    return F.slice(F.regexp_extract_all(c, F.lit(r"(?U)#(\w+)"), 1), 1, most)


def wikilinks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\[\[([a-z0-9-]+)\]\]"), 1)


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a substring; 0 for an empty needle."""
    n = F.length(needle)
    return F.when(n > 0, ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / n).cast("long")).otherwise(0)


def pack_paragraphs(c: Column, size: int) -> Column:
    """Paragraphs joined while they fit `size` characters; a longer one is sliced."""
    paras = F.flatten(F.transform(F.split(F.coalesce(c, F.lit("")), "\n\n"), lambda p: chunks(p, size)))
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(""))
    fits = lambda a, p: (F.size(a) > 0) & (F.length(last(a)) + 2 + F.length(p) <= size)
    join = lambda a, p: F.when(fits(a, p), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat(last(a), F.lit("\n\n"), p)))).otherwise(F.concat(a, F.array(p)))
    return F.aggregate(F.filter(paras, lambda p: F.trim(p) != ""), F.array().cast("array<string>"), join)


def token_shaped(c: Column) -> Column:
    """8 to 64 ASCII letters, digits, hyphens and underscores."""
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_-]{8,64}\z"), F.lit(False))


def strip_file_date(name: Column) -> Column:
    """File name without a leading or trailing ISO date."""
    return F.regexp_replace(name, r"^\d{4}-\d{2}-\d{2}[-_]|[-_]\d{4}-\d{2}-\d{2}(?=\.[a-z]+$)", "")


def summary_of(kind: Column, title: Column, summary: Column, content: Column) -> Column:
    """One-line summary of an extraction by its kind; credentials have none."""
    pick = F.when(kind.isin("concept_drop", "life_entry"), title).when(kind.isin("project_update", "query_intent"), summary).when(kind == "personal_log", content)
    return F.substring(F.coalesce(pick, F.lit("")), 1, SUMMARY_CHARS)


def render_page(kind: Column, title: Column, context: Column, summary: Column, content: Column, claims: Column) -> Column:
    """Page text of an extraction; absent parts leave no line."""
    heading = F.concat(F.lit("# "), F.coalesce(title, F.lit("untitled")))
    points = F.concat_ws("\n", F.transform(F.coalesce(claims, F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x)))
    note = F.when(F.length(context) > 0, F.concat(F.lit("_Context: "), context, F.lit("_")))
    parts = F.array(heading, F.nullif(summary, F.lit("")), F.nullif(content, F.lit("")), F.nullif(points, F.lit("")), note)
    return F.when(kind == "credential_entry", heading).otherwise(F.concat_ws("\n\n", F.array_compact(parts)))


# The headings, marks and fixed lines of the pages below, which other operators and
# earlier pages rely on.


def wiki_page(title: Column, summary: Column, claims: Column, url: Column, source: Column, domain: Column, day: Column) -> Column:
    """Page of a concept: title, first sentence as a quotation, key points, the rest of the
    summary, the source, and an empty Related section at the end, where links are added.
    Parts without content are left out."""
    s = split_tldr(summary)
    points = F.when(F.size(claims) > 0, F.concat(F.lit("## Key points\n\n"), F.array_join(F.transform(claims, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n")))
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("- **URL**: <"), url, F.lit(">")),
        F.when(F.length(domain) > 0, F.concat(F.lit("- **Domain**: `"), domain, F.lit("`"))),
        F.concat(F.lit("- **Type**: "), source),
        F.concat(F.lit("- **Accessed**: "), day),
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("# "), title, F.lit("\n")),
        F.when(F.length(s["tldr"]) > 0, F.concat(F.lit("> "), s["tldr"], F.lit("\n"))),
        points,
        F.when(F.length(s["rest"]) > 0, F.concat(F.lit("## Overview\n\n"), s["rest"], F.lit("\n"))),
        F.when(F.length(url) > 0, F.concat(F.lit("## Source\n\n"), lines, F.lit("\n"))),
        F.lit("## Related\n"),
    )


def project_page(name: Column, progress: Column, status: Column, deadline: Column, blocked_by: Column) -> Column:
    point = lambda k, v: F.when(F.length(v) > 0, F.concat(F.lit(f"- **{k}:** "), v))
    first = F.concat(F.lit("- **Progress:** "), F.coalesce(progress, F.lit("")))
    return F.concat(F.concat_ws("\n", F.concat(F.lit("# "), name), F.lit(""), first, point("Status", status), point("Deadline", deadline), point("Blocker", blocked_by)), F.lit("\n"))


def life_entry(at: Column, title: Column, slug: Column, content: Column, context: Column) -> Column:
    """Entry that is added to the page of a life area."""
    note = F.when(F.length(context) > 0, F.concat(F.lit("\n_Context: "), context, F.lit("_")))
    head = F.concat(F.lit("## "), at, F.lit(" — "), F.coalesce(F.nullif(title, F.lit("")), slug))
    return F.concat(F.concat_ws("\n", head, F.lit(""), F.regexp_replace(content, r"(?U)\s+\z", ""), note), F.lit("\n"))


def credential_page(label: Column, body: Column) -> Column:
    return F.concat(F.lit("# "), label, F.lit("\n\n"), body, F.lit("\n"))


def personal_page(content: Column, context: Column) -> Column:
    """Body of a thought that belongs to no page of its own."""
    note = F.when(F.length(context) > 0, F.concat(F.lit("\n_Context: "), context, F.lit("_\n"))).otherwise("")
    return F.concat(F.regexp_replace(content, r"(?U)\s+\z", ""), F.lit("\n"), note)


def query_page(question: Column, scope: Column) -> Column:
    return F.concat(F.lit("Query: "), question, F.lit("\nscope: "), scope, F.lit("\n"))


def decision_entry(at: Column, drop_type: Column, kind: Column, slug: Column, confidence: Column, writes: Column, reason: Column) -> Column:
    """Log entry of one decision; a credential shows neither its slug nor its pages."""
    secret = kind == "credential"
    shown = F.transform(writes, lambda w: F.when(w.startswith("life/credentials/"), "life/credentials/(redacted)").otherwise(w))
    parts = (
        F.lit("\n## "), at, F.lit("\nPipeline: "), drop_type, F.lit("\nTarget: "), kind, F.lit(" / slug="), F.when(secret, "(redacted)").otherwise(slug),
        F.lit("\nPath: orchestrator → classifier → extractor → verifier → writer\nConfidence: "), confidence, F.lit("\nWrites: "), F.array_join(shown, ", "),
        F.lit("\nReasoning: "), reason, F.lit("\n"),
    )
    return F.concat(*parts)


def commit_message(kind: Column, drop_type: Column, path: Column, slug: Column, who: str) -> Column:
    """Message of the commit of one drop, after the name of the committing service; a
    credential is not named."""
    leaf = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")
    name = F.substring(F.when(F.length(path) > 0, leaf).otherwise(slug), 1, 40)
    return F.when(kind == "credential", f"{who}: credential (redacted)").otherwise(F.concat(F.lit(f"{who}: "), drop_type, F.lit(" — "), name))


def run_log(job: Column, day: Column, started: Column, seconds: Column, ok: Column, error: Column, extra: Column) -> Column:
    """Page of one run of a job; `extra` (name, value) pairs follow in their order."""
    more = F.transform(extra, lambda x: F.concat(x["name"], F.lit(": "), x["value"]))
    return F.concat(
        F.concat_ws(
            "\n",
            F.concat(F.lit("# "), job, F.lit(" — "), day),
            F.lit(""),
            F.concat(F.lit("started_at: "), started),
            F.concat(F.lit("duration_s: "), F.format_string("%.2f", seconds)),
            F.concat(F.lit("ok: "), F.when(ok, "True").otherwise("False")),
            F.when(~ok, F.concat(F.lit("error: "), F.coalesce(error, F.lit("")))),
            F.nullif(F.array_join(more, "\n"), F.lit("")),
        ),
        F.lit("\n"),
    )


def first_replaced(c: Column, pattern: str, value: str) -> Column:
    """The first match of a pattern replaced, later ones kept."""
    at = F.regexp_instr(c, F.lit(pattern))
    hit = F.regexp_substr(c, F.lit(pattern))
    return F.when(at > 0, F.concat(F.substr(c, F.lit(1), at - 1), F.lit(value), F.substr(c, at + F.length(hit)))).otherwise(c)
