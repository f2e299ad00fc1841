"""Core operators on small literal inputs."""

import math
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import dates, scrub, text, urls
from quillspark.operators import delivery, evals, gate, mirror, pages, search, stats
from quillspark.sources import jsonl, vault


def one(spark, column, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} {'timestamp' if isinstance(v, datetime) else 'array<string>' if isinstance(v, list) else 'string'}" for n, v in cols.items())).select(column(*map(F.col, names)).alias("r")).first()["r"]


# ---- repeated deliveries ---------------------------------------------------------


def trace(spark, rows):
    return spark.createDataFrame([(s, d, t, r, "x") for s, d, t, r in rows], "record_seq long, drop_id string, ts string, received_at timestamp, producer string")


T = lambda m: datetime(2024, 1, 1, 0, m)
ROWS = [
    (1, "00aa11bb22cc", "2024-01-01T10:00:00.000000+09:00", T(5)),
    (2, "00AA11BB22CC ", "2024-01-01T01:00:00Z", T(3)),
    (3, "00aa11bb22cc", "2024-01-01T01:00:00.0000Z", T(3)),
    (4, "00aa11bb22cc", "2024-01-01T01:00:00.000001Z", T(1)),
    (5, "odd id", "2024-01-01T01:00:00Z", T(1)),
    (6, " ODD ID", "2023-12-31T20:00:00-05:00", None),
    (7, None, "2024-01-01T01:00:00Z", T(1)),
    (8, "00aa11bb22cc", "yesterday", T(1)),
    (9, "00aa11bb22cc", None, T(1)),
    (10, "00aa11bb22cc", "2024-13-45T99:00:00Z", T(1)),
    (11, "00aa11bb22cc", "2024-01-01 01:00:00,000001Z", T(2)),
    (12, "00aa11bb22cc", "", T(2)),
]


def test_repeats_are_found_however_written(spark):
    m = delivery.messages(trace(spark, ROWS))
    kept = delivery.accept_once(m)
    assert {r.record_seq for r in kept.collect()} == {2, 4, 5}
    assert {r[0] for r in delivery.repeats(m, kept).collect()} == {1, 3, 6, 11}


def test_deliveries_in_batches_equal_one_delivery(spark):
    m = delivery.messages(trace(spark, ROWS))
    for minute in range(0, 7):
        kept = delivery.replay(m, F.col("received_at") < F.lit(T(minute)))
        assert {r.record_seq for r in kept.collect()} == {2, 4, 5}, minute
    empty = m.where("false")
    assert delivery.replay(empty, F.lit(True)).count() == 0 and delivery.remember(empty).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["0" * 12, "1" * 12]), st.integers(0, 12)), max_size=25), st.lists(st.tuples(st.sampled_from(["0" * 12, "2" * 12]), st.integers(0, 12)), max_size=25))
def test_ranges_stay_disjoint_and_exact(spark, a, b):
    make = lambda rows: spark.createDataFrame([(p, n, T(0), i) for i, (p, n) in enumerate(rows)], "producer string, number long, received_at timestamp, record_seq long")
    first = delivery.accept_once(make(a))
    state = delivery.remember(first)
    late = delivery.accept_once(make(b), state)
    assert {(r.producer, r.number) for r in late.collect()} == set(b) - set(a)
    ranges = [(r.producer, r.lo, r.hi) for r in delivery.remember(late, state).collect()]
    covered = [(p, n) for p, lo, hi in ranges for n in range(lo, hi + 1)]
    assert len(covered) == len(set(covered)) and set(covered) == set(a) | set(b)
    assert not {(p, hi + 1) for p, _, hi in ranges} & {(p, lo) for p, lo, _ in ranges}


def test_one_hot_message(spark):
    rows = spark.range(9000).select(F.lit("0" * 12).alias("producer"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("number"), F.lit(T(0)).alias("received_at"), F.col("id").alias("record_seq"))
    assert delivery.repeats(rows, delivery.accept_once(rows)).count() == 3000 - 1 + 1  # number 7 also occurs once by itself


def test_intermediate_tables_can_be_released(spark):
    import os

    from quillspark.session import materialise, release, shared_dir

    df = materialise(spark.range(5), "five")
    assert df.count() == 5
    folder = f"{shared_dir(spark)}/quillspark-{spark.sparkContext.applicationId}".removeprefix("file://")
    assert os.listdir(folder)
    release(spark)
    assert not os.path.exists(folder)


# ---- statistics ------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 20, 100, 101])
def test_nearest_rank(spark, n):
    df = spark.range(1, n + 1)
    got = stats.quantiles(df, "id").first()
    assert [got[k] for k in stats.QUANTILES] == [math.ceil(q * n) for q in stats.QUANTILES.values()]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 5000))), max_size=60))
def test_quantiles_by_key(spark, rows):
    df = spark.createDataFrame(rows, "k string, value long")
    got = {r.k: (r.n, r.p50, r.p95, r.min, r.max) for r in stats.quantiles(df, "value", "k").collect()}
    want = {}
    for k in {k for k, v in rows if v is not None}:
        x = sorted(v for j, v in rows if j == k and v is not None)
        want[k] = (len(x), x[math.ceil(0.5 * len(x)) - 1], x[math.ceil(0.95 * len(x)) - 1], x[0], x[-1])
    assert got == want


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "ts string, duration_ms double, blocked_reason string, escalated boolean, target_kind string, stage_latency_ms map<string,double>, n long")


def test_summary_and_rates(spark):
    now = datetime(2024, 1, 31)
    df = rows_of(spark, [("2024-01-30T00:00:00Z", 100.9, "x", True, "wiki", {"writer": 100.0, "odd": 5.0}, 1), ("2024-01-30T00:00:00+00:00", 150.0, "", None, "wiki", {"writer": 150.0}, 1), ("2024-01-29T00:00:00Z", -1.0, "y", True, None, None, 1), ("2023-12-01T00:00:00Z", 9.0, None, False, "life", {}, 1), (None, 9.0, None, None, "life", {}, 1), ("junk", 9.0, None, None, "life", {}, 1)])
    w = stats.in_window(df, now, 7)
    s = stats.summary(w, "duration_ms").first()
    assert (s.n, s.p50, s.p99, s["mean"], s["min"], s["max"], s.warming_up) == (2, 100, 150, 125, 100, 150, True)
    r = stats.rates(w).first()
    assert (r.n, r.blocked, r.escalated, r.error_rate) == (2, 2, 2, 1.0)
    assert [(x.stage, x["mean"]) for x in stats.by_stage(w).collect()] == [("writer", 125)]
    assert [tuple(x) for x in stats.kind_counts(w).collect()] == [("wiki", 2)]
    e = stats.in_window(df.where("false"), now, 7)
    assert stats.summary(e, "duration_ms").first().p99 == 0 and stats.rates(e).first().error_rate is None
    assert stats.report(e).count() == 3


def test_jsonl(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"ts": "2024-01-01T00:00:00Z", "duration_ms": 5}\njunk\n{"drop_id": "a"}\n[1]\n\n{"ts": "x", "stage_latency_ms": {"writer": 1}}\n')
    got = jsonl.read_trace(spark, str(tmp_path)).collect()
    assert [r.ts for r in got] == ["2024-01-01T00:00:00Z", "x"] and got[1].stage_latency_ms == {"writer": 1.0}
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "ok.jsonl").write_text('// comment\n{"id": "a"}\n')
    assert [r.id for r in jsonl.read_strict(spark, str(tmp_path / "f"), "id string").collect()] == ["a"]
    (tmp_path / "f" / "bad.jsonl").write_text('{"x": 1}\n')
    with pytest.raises(Exception, match="without id"):
        jsonl.read_strict(spark, str(tmp_path / "f"), "id string").collect()


# ---- scalars ---------------------------------------------------------------------


def py_slug(t):
    import re

    s = re.sub(r"[^a-z0-9]+", "-", t.lower()).strip("-")
    return (s or "untitled")[:50]


@settings(max_examples=30, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_categories=["Cs"], exclude_characters="\x00"), max_size=80))
def test_slugify(spark, t):
    assert one(spark, text.slugify, t=t) == py_slug(t)


@pytest.mark.parametrize(("v", "want"), [("Project", "project"), ("daily-only", "daily_only"), ("wiki page", "wiki"), ("cred", "credential"), ("", "project"), (None, "daily_only"), ("zzz", "daily_only")])
def test_normalize_literal(spark, v, want):
    assert one(spark, lambda c: text.normalize_literal(c, text.KINDS, "daily_only"), v=v) == want


def test_commits(spark):
    got = lambda m, b="": tuple(one(spark, text.conventional_commit, m=m, b=b))
    assert got("feat(core)!: x y") == ("feat", "x y", True)
    assert got("FIX: a") == ("fix", "a", False)
    assert got("plain") == ("other", "plain", False)
    assert got("docs: a", "Breaking Change: b") == ("docs", "a", True)


def test_text_helpers(spark):
    assert tuple(one(spark, text.split_tldr, t="One. Two. Three")) == ("One.", "Two. Three")
    assert tuple(one(spark, text.split_tldr, t=None)) == ("", "")
    assert one(spark, lambda c: text.snippet(c, 5), t="abcd efgh") == "abcd…"
    assert one(spark, text.memory_line, p="wiki/a-very-long-name-for-a-page.md", s="s", c="high").startswith("a-very-long-name-for-a-page wiki/")
    assert "secret" not in one(spark, text.drop_entry, t="09:00", k="credential", d="secret", p="secret.md", s="secret")
    assert one(spark, lambda c: text.chunks(c, 3), t="abcdefg") == ["abc", "def", "g"]
    assert one(spark, text.hashtags, t="a #one #två b#three") == ["one", "två", "three"]
    assert one(spark, lambda c, n: text.occurrences(c, n), c="aaaa", n="aa") == 2
    assert one(spark, text.drop_id, t="abc") == "ba7816bf8f01"
    u = one(spark, lambda t, d: text.calendar_url("https://c.example/r", t, F.lit("2024-01-02"), F.lit(None).cast("string"), d, F.lit("")), t="a b&c~*", d="x" * 5000)
    assert "text=a+b%26c~%2A&dates=20240102T000000Z%2F20240102T000000Z" in u and len(u) <= 2000


def test_urls(spark):
    assert one(spark, urls.extract_urls, t="(https://a.example/x). https://a.example/x, http://b.example") == ["https://a.example/x", "http://b.example"]
    assert one(spark, urls.dispatch, u="https://youtu.be/abc.pdf") == "youtube"
    assert one(spark, urls.dispatch, u="https://a.example/B.PPTX") == "office"
    assert one(spark, urls.arxiv_id, u="https://arxiv.org/pdf/hep-ph/9901001v2") == "hep-ph/9901001"
    assert one(spark, urls.video_id, u="https://www.youtube.com/shorts/abcdefghijk?x") == "abcdefghijk"
    assert one(spark, urls.url_slug, u="https://a.example/Some%20Page/?q=1") == one(spark, text.drop_id, t="https://a.example/Some%20Page/?q=1")[:8]
    for u, why in {"ftp://a": "scheme_not_allowed", "http://": "no_hostname", "http://10.1.2.3/": "private_ip", "http://u@127.0.0.1:80": "private_ip", "http://169.254.169.254": "private_ip", "http://100.100.100.200": "blocked_net", "http://metadata/": "metadata_host", "https://8.8.8.8/x": "ok", "http://[::1]/": "private_ip", "http://[fd00:ec2::254]": "private_ip", "http://[::ffff:10.0.0.1]:80/": "private_ip", "http://[2606:4700::1111]/": "ok", "http://[2001:db8::1]/": "private_ip", "http://[fe80::1%25eth0]/": "private_ip", "http://127.1/": "encoded_ip", "http://2130706433": "encoded_ip", "http://0x7f000001/": "encoded_ip", "http://0177.0.0.1/": "encoded_ip", "http://localhost./": "private_ip", "http://a.localhost": "private_ip", "http://198.18.0.1": "private_ip", "http://192.0.0.5/": "private_ip", "http://203.0.113.9": "private_ip", "http://172.32.0.1": "ok", "http://300.1.1.1": "private_ip", "http://100.128.0.1": "ok", "https://a.example": "ok", None: "scheme_not_allowed"}.items():
        assert one(spark, urls.safe_url, u=u) == why, u
    assert one(spark, urls.attachment_class, m="", n="a.HWPX") == "hwp"


def test_dates(spark):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    d = lambda s: datetime.fromisoformat(s)
    assert str(one(spark, dates.last_monday, t=d("2024-01-29 21:59:00"))) == "2024-01-22"
    assert str(one(spark, dates.last_monday, t=d("2024-01-29 22:00:00"))) == "2024-01-29"
    assert one(spark, lambda c: dates.relative_time(c, now), t=d("2024-01-29 20:00:00")) == "yesterday"
    assert tuple(one(spark, lambda c: dates.deadline_label(c, now), t=d("2024-01-30 23:00:00"))) == ("overdue 1d", "urgent")
    assert one(spark, lambda c: dates.decay(F.lit("high"), c, now), t=d("2023-12-17 00:00:00")) == "medium"
    assert [one(spark, dates.duration_hours, t=t) for t in ("24h", "7d", "1w", "5", "-3d", "x", None, "2w now")] == [24, 168, 168, 5, 24, 24, 24, 336]


def test_scrub(spark):
    f = lambda t, **k: one(spark, lambda c: scrub.chain(c, ["acme app"], **k), t=t)
    assert f("mail a@b.co on 2024-01-02 for $1,200") == "mail user@example.com on [DATE] for [AMOUNT]"
    assert f("call 010-1234-5678, née müller@büro.example") == "call +00-0000-0000, née user@example.com"
    assert f("see secret.github.com/a/b, GitHub.com/a?b=1 and http://GITHUB.com/c") == "see https://example.com/X https://github.com/a and http://github.com/c"
    two = lambda t: one(spark, lambda c: scrub.known_slugs(c, ["app", "acme app", "", "c++ (x)"]), t=t)
    assert two("App and acme APP, apps") == "project-a and project-b, apps"
    assert f("see https://github.com/a/b?x=1 and http://secret.corp/y?z") == "see https://github.com/a/b and https://example.com/X"
    assert f("the ACME App here") == "the project-a here"
    assert "a@" in f("mail a@b.co", compat_order=True)
    assert one(spark, scrub.residual_secret, t="x sk-" + "a" * 20) and not one(spark, scrub.residual_secret, t="sk-short")
    assert f(None) is None and f("") == ""


# ---- pages -----------------------------------------------------------------------


def store(spark, rows):
    return spark.createDataFrame(rows, "path string, content string, mtime timestamp")


def test_guard(spark, tmp_path):
    for p in ("wiki/a.md", "life/credentials/b.md", "private/c.md", "log.jsonl", "x.bin"):
        (tmp_path / p).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / p).write_text("text\n")
    got = {r.path for r in vault.load(spark, str(tmp_path), ["private/"]).collect()}
    assert got == {"wiki/a.md", "log.jsonl"}
    df = store(spark, [("/etc/x", "", None), ("a/../b", "", None), ("ok.md", "", None), (None, "", None), ("life/credentials/x.md", "", None)])
    assert [r.path for r in vault.guarded(df).collect()] == ["ok.md"]
    assert vault.read_page(df, "none").first()[0] == ""
    kinds = {r.path.rsplit("/", 1)[-1]: r.is_text for r in vault.attachments(spark, str(tmp_path)).collect()}
    assert kinds["x.bin"] and len(kinds) == 5


def test_frontmatter(spark):
    fm = lambda c: tuple(one(spark, vault.frontmatter, c=c))
    assert fm("---\na: 1\n---\n\nbody") == ("a: 1\n", "body")
    assert fm("no header") == (None, "no header") and fm("---\nopen") == (None, "---\nopen")
    assert one(spark, lambda h: vault.header_value(h, "status"), h="x: 1\nstatus: 'done' \n") == "done"
    assert one(spark, lambda h: vault.header_list(h, "tags"), h="tags: [a, 'b c', ]") == ["a", "b c"]


def test_index_lines_round_trip(spark):
    df = spark.createDataFrame([("a-b", "some words", ["x", "y"], "2024-01-02"), ("c", "w", [], "")], "slug string, summary string, tags array<string>, day string")
    lines = df.select(F.lit("i").alias("path"), F.lit(1).alias("line_no"), text.index_line(*map(F.col, ("slug", "summary", "tags", "day"))).alias("line"))
    got = sorted((r.slug, r.summary, r.tags, r.day) for r in vault.index_rows(lines).collect())
    assert got == [("a-b", "some words", ["x", "y"], "2024-01-02"), ("c", "w", [], None)]


def test_life_entries_and_carried_headings(spark):
    df = store(spark, [("life/a.md", "# x\n## 2024-01-01 10:00 — One\n\n_c_\n first \n## 2024-01-02 11:00 — Two\n", None), ("e", "", None)])
    assert [(r.ts, r.title, r.snippet) for r in vault.life_entries(df).orderBy("ts").collect()] == [("2024-01-01 10:00", "One", "first"), ("2024-01-02 11:00", "Two", None)]
    lines = vault.lines(store(spark, [("p", "top\n### a\r\n- 1\n- 2\n### b\n- 3", None)]))
    assert [(r.line, r.head) for r in vault.carried(lines, "### ", "head").orderBy("line_no").collect()] == [("- 1", "a"), ("- 2", "a"), ("- 3", "b")]


def test_backlinks(spark):
    f = lambda c: one(spark, lambda x: pages.backlink(x, F.lit("new")), c=c)
    assert f("x\n## Related\n- [[a]]\n## Next\ny") == "x\n## Related\n- [[a]]\n- [[new]]\n## Next\ny"
    assert f("x [[new]]") == "x [[new]]" and f(f("x")) == f("x") == "x\n\n## Related\n- [[new]]\n"


def test_links_and_peers(spark):
    p = store(spark, [("wiki/a.md", "[[b]] [[zz]] [[zz]]", None), ("wiki/b.md", None, None)])
    assert sorted(tuple(r) for r in pages.broken_links(p).collect()) == [("wiki/a.md", "zz")] * 2
    ptr = spark.createDataFrame([("a", "wiki/a.md"), ("b", "wiki/b.md"), ("c", "life/c.md"), ("d", None)], "name string, path string")
    assert {r.name for r in pages.orphan_pointers(ptr, p).collect()} == {"c", "d"}
    i = spark.createDataFrame([("q", ["x", "y", "x"]), ("m", ["x", "y"]), ("k", ["x"]), ("b", ["y"]), ("n", None), ("e", [])], "slug string, tags array<string>")
    got = [(r.peer, r.overlap, r.place) for r in pages.tag_peers(i.where("slug = 'q'"), i, 2).orderBy("place").collect()]
    assert got == [("m", 2, 1), ("b", 1, 2)]


def test_upserts_and_paths(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("b", 3, None)], "k string, at int, v string")
    assert sorted(tuple(r) for r in pages.latest(df, "k", "at").collect()) == [("a", 2, "x"), ("b", 3, None)]
    n = pages.numbered_paths(spark.range(11).select(F.lit("r/x.md").alias("base"), "id"), "base", "id").orderBy("id").collect()
    assert [r.path for r in n][:2] == ["r/x.md", "r/x-2.md"] and n[8].path == "r/x-9.md" and n[9].path is None


def test_search(spark):
    p = store(spark, [("a.md", "one $x\ntwo", datetime(2024, 1, 30)), ("raw/b.md", "one", None), ("c.md", None, datetime(2023, 1, 1))])
    assert [(r.path, r.line_no) for r in search.grep(search.scope(p), "$x").collect()] == [("a.md", 1)]
    assert search.grep(p, "^one", regex=True).count() == 2 and search.grep(p, "(", regex=True).count() == 0
    now = datetime(2024, 1, 31)
    assert search.since(p, "7d", now).count() == 2 and search.since(p, "junk", now).count() == 3 and search.since(p, "2024-01-30T12:00:00Z", now).count() == 1


def test_evals(spark):
    a = spark.createDataFrame([("c", "1", "x"), ("c", "2", "y")], "agent string, k string, response string")
    b = spark.createDataFrame([("c", "1", "x"), ("c", "2", "z"), ("c", "3", None)], "agent string, k string, response string")
    assert sorted(tuple(r) for r in evals.drift(a, b, "agent", "k").collect()) == [("c", "2", "diff"), ("c", "3", "new_entry")]
    r = evals.ablation(a, b, "k", ["response"]).first()
    assert (r.n, r.diverged, r.share, r.no_effect) == (2, 1, 0.5, False)
    assert {(x.k, x.hit) for x in evals.replay(b.select("k"), a.select("k", "response"), "k").collect()} == {("1", True), ("2", True), ("3", False)}
    with pytest.raises(Exception, match="no recorded response"):
        evals.replay(b.select("k"), a.select("k", "response"), "k", strict=True).collect()
    m = spark.createDataFrame([(1, {"a": "1", "b": "2"})], "id long, fields map<string,string>")
    n = spark.createDataFrame([(1, {"a": "1", "b": "3", "c": "4"})], "id long, fields map<string,string>")
    assert sorted((r.field, r.change) for r in evals.deep_diff(m, n, "id").collect()) == [("b", "changed"), ("c", "added")]
    s = evals.similarity(spark.createDataFrame([("abcd", "bcde"), (None, None)], "x string, y string"), "x", "y").collect()
    assert [r.similarity for r in s] == [0.75, 1.0]
    got = evals.with_model(b.select("k"), lambda pdf: pdf.assign(out=pdf.k + "!"), "k string, out string").collect()
    assert {r.out for r in got} == {"1!", "2!", "3!"}


def test_cooldown(spark):
    rows = [("u", datetime(2024, 1, 1, 0, 0, s), i, "c") for i, s in enumerate([0, 4, 9, 10, 15, 21])] + [("v", datetime(2024, 1, 1), 1, "c"), ("v", datetime(2024, 1, 1), 0, "c"), (None, datetime(2024, 1, 1), 0, "c"), ("v", None, 9, "c")]
    df = spark.createDataFrame(rows, "u string, ts timestamp, i int, ok string")
    got = {(r.u, r.i): r.ok for r in gate.cooldown(df, "u", "ts", "i", 10).collect()}
    assert [got["u", i] for i in range(6)] == [True, False, False, True, False, True]
    assert got["v", 0] and not got["v", 1] and len(got) == 8
    assert gate.cooldown(df.where("false"), "u", "ts", "i", 10).count() == 0


def test_page_store(spark, tmp_path):
    s = mirror.PageStore(spark, str(tmp_path / "store"))
    df = lambda *r: spark.createDataFrame(r, "path string, content string")
    assert s.commit(df(("a", "1"), ("b", "1")), "c1") == 1
    assert s.commit(df(("a", "2")), "c2") == 2 and s.commit(df(("a", "3")), "c2") == 2
    assert s.commit(df(("a", "3")).where("false"), "c3") is None
    assert {tuple(r) for r in s.read().collect()} == {("a", "2"), ("b", "1")}
    assert {tuple(r) for r in mirror.upsert(df(("a", "n")), df(("a", "o"), ("z", "o"))).collect()} == {("a", "n"), ("z", "o")}
    assert mirror.verify(df(("a", "n")), df(("z", "o")), "a").first().verdict == "critical_missing"
    assert mirror.append_shielded(df(("a", "1")), str(tmp_path / "store" / "v=000000000001" / "_id-c1")) is False
    mirror.append_jsonl(df(("a", "1")), str(tmp_path / "log"))
    mirror.append_jsonl(df(("b", "1")), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_racing_writers_never_share_a_version(spark, tmp_path, monkeypatch):
    df = lambda *r: spark.createDataFrame(r, "path string, content string")
    a, b = (mirror.PageStore(spark, str(tmp_path / "store")) for _ in range(2))
    assert a.commit(df(("p", "0")), "c0") == 1
    claim = mirror.PageStore._claim

    def overtaken(self, n):  # the other writer comes between the look and the claim
        if self is a and n == 2:
            assert claim(b, 2)
        return claim(self, n)

    monkeypatch.setattr(mirror.PageStore, "_claim", overtaken)
    assert a.commit(df(("p", "1")), "c1") == 3
    monkeypatch.setattr(mirror.PageStore, "_claim", lambda self, n: False)
    with pytest.raises(mirror.ConflictError):
        a.commit(df(("p", "2")), "c2")
    monkeypatch.undo()
    assert b.commit(df(("p", "3"), ("q", "1")), "c3") == 4 and a.versions() == [1, 3, 4]
    assert a.snapshot(upto=3) == 3 and a.snapshot() == 4 and b.commit(df(("q", "2")), "c4") == 5
    assert {tuple(r) for r in a.read().collect()} == {("p", "3"), ("q", "2")}


def test_nested_diff(spark):
    rows = [(1, '{"a": 1, "b": [1, {"c": "x"}], "d": null}', '{"a": "1", "b": [1, {"c": "y"}, 3], "e": 2}'), (2, "same", "same"), (3, "text", None), (4, "[1]", "[1]"), (5, None, None)]
    got = evals.response_diff(spark.createDataFrame(rows, "id int, a string, b string"), "a", "b").orderBy("id").collect()
    assert [(d.path, d.kind) for d in got[0].diffs] == [("/a", "type"), ("/b", "list_len"), ("/b[1]/c", "value"), ("/d", "removed"), ("/e", "added")]
    assert got[2].diffs[0].kind == "text" and not got[1].diffs and not got[3].diffs and not got[4].diffs


def test_headers(spark):
    h = "a: 1 # note\ntags:\n  - x\n  - 'y z'\nlist: [p, \"q, r\"]\nmore:\n  deep: v\nbroken line\nz: ''\n"
    got = vault.parse_header(h)
    assert got["fields"] == {"a": "1", "tags": '["x", "y z"]', "list": '["p", "q, r"]', "more.deep": "v", "z": ""} and got["error"] == "line 8: no key"
    assert vault.parse_header(None) == {"fields": {}, "error": None}
    assert one(spark, lambda c: vault.header_items(c, "tags"), h=h) == ["x", "y z"] and one(spark, lambda c: vault.header_items(c, "list"), h="list: [a, b]\n") == ["a", "b"]


def test_page_texts(spark):
    snip = lambda t: one(spark, lambda c: text.pipeline_snippet(c, F.lit("u"), F.lit("web"), 5), t=t)
    assert snip("  abc ") == "\n\n[Extracted from u (web)]\nabc" and snip("abcd efgh").endswith("abcd…\n[truncated — full text in raw/]")
    assert one(spark, text.html_text, t="<p>a&lt;b</p><script>x<y</script>\n\n c") == "a<b\nc"
    null = F.lit(None).cast("string")
    page = one(spark, lambda t, s, c: text.wiki_page(t, s, c, null, null, null, null), t="T", s="One. Two.", c=["k"])
    assert page == "# T\n\n> One.\n\n## Key points\n\n- k\n\n## Overview\n\nTwo.\n\n## Related\n"
    d = one(spark, lambda s: text.decision_entry(F.lit("t"), F.lit("credential"), F.lit("credential"), s, F.lit("high"), F.array(F.lit("life/credentials/secret.md")), F.lit("r")), s="secret")
    assert "secret" not in d and "(redacted)" in d


# ---- rewriting and reports -------------------------------------------------------


def test_paragraph_packing(spark):
    f = lambda t: one(spark, lambda c: text.pack_paragraphs(c, 10), t=t)
    assert f("abc\n\ndef\n\nghijkl") == ["abc\n\ndef", "ghijkl"]
    assert f("abcdefghijklm\n\nn") == ["abcdefghij", "klm\n\nn"]
    assert f("") == [] and f(None) == [] and f("\n\n \n\n") == []


def test_page_rewriting(spark):
    f = lambda t: one(spark, lambda c: pages.replace_section(c, "## A", F.lit("new")), t=t)
    assert f("x\n## A\nold\nold\n## B\ny") == "x\n## A\nnew\n\n## B\ny"
    assert f("x\n## A\nold") == "x\n## A\nnew\n" and f("x") == "x"
    p = store(spark, [("projects/a.md", "status: active\nstatus: b", None), ("wiki/b.md", "status: x", None), ("projects/c.md", None, None)])
    got = {r.path: r.content for r in pages.move_page(p, "projects/", "archive/", "done").collect()}
    assert got == {"archive/a.md": "status: done\nstatus: b", "archive/c.md": None}


def test_names_and_tokens(spark):
    assert [one(spark, text.token_shaped, t=t) for t in ("abcd-_12", "short", "a b c d e f", "x" * 65, None, "abcdefgh\n")] == [True, False, False, False, False, False]
    assert [one(spark, text.strip_file_date, t=t) for t in ("2024-01-02-a.md", "a_2024-01-02.md", "a.md")] == ["a.md"] * 3
    assert one(spark, text.life_area, a="Pet Care!", b=["groceries", "pet-care"]) == "pet-care"
    assert one(spark, text.life_area, a="", b=["x"]) is None and one(spark, text.life_area, a="zz", b=["x"]) is None


def test_request_keys(spark):
    k = evals.request_key("a", "m", "é", 0.5)
    assert len(k) == 16 and k != evals.request_key("a", "m", "é", 0.6)
    df = spark.createDataFrame([("a", "m", "é", 0.5)], "agent string, model string, prompt string, temperature double")
    assert evals.with_keys(df).first().prompt_hash == k


def test_series_and_fan_out(spark):
    counts = spark.createDataFrame([("a", datetime(2024, 1, 2).date(), 3)], "slug string, day date, n long")
    f = pages.fill_days(counts, spark.createDataFrame([("a",), ("b",)], "slug string"), "slug", F.lit("2024-01-03").cast("date"), 3)
    assert sorted((r.slug, str(r.day), r.n) for r in f.collect())[:3] == [("a", "2024-01-01", 0), ("a", "2024-01-02", 3), ("a", "2024-01-03", 0)] and f.count() == 6
    s = spark.range(1).select(pages.sparkline(F.array(F.lit(0.0), F.lit(2.0))).alias("p")).first()["p"]
    assert s == "0.0,13.0 70.0,1.0"
    d = spark.createDataFrame([(1, "wiki", "wiki/a.md", datetime(2024, 1, 2)), (2, "daily_only", None, datetime(2024, 1, 2)), (3, "credential", "life/credentials/x.md", datetime(2024, 1, 2)), (4, "wiki", "w", None)], "record_seq long, target_kind string, target_path string, received_at timestamp")
    got = {}
    for r in pages.fan_out(d).collect():
        got.setdefault(r.record_seq, set()).add(r.role)
    assert got == {1: {"page", "index", "log", "pointer", "decision"}, 2: {"log", "decision"}, 3: {"page", "log", "decision"}}
    c = spark.createDataFrame([("s1", "1", "r", "- x"), ("s2", "2", "q", "- about beta"), ("s3", "3", "q", "- alphabet")], "sha string, key string, repo string, line string")
    p = spark.createDataFrame([("alpha", ["r"]), ("beta", [])], "slug string, repos array<string>")
    assert sorted((r.slug, r.sha) for r in pages.link_commits(c, p).collect()) == [("alpha", "s1"), ("beta", "s2")]
