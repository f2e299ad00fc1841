"""Look-alike, leak, container, personal-information and canonical-list operators."""

import random
import unicodedata

import pytest

pytest.importorskip("quillspark.llm")

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import canonical, leakage, lookalike, packing, pii

LONG = "word " * 60_000


# ---- look-alikes -----------------------------------------------------------------


def test_skeleton_joins_what_looks_the_same():
    base = "Café naïve, the old well 42!"
    same = [
        unicodedata.normalize("NFD", base),
        base.replace("a", "а").replace("e", "е"),  # Cyrillic
        base.replace(" ", " "),
        base.replace("l", "l​"),
        "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in base),
        "﻿" + base.replace("o", "ο"),  # Greek
    ]
    assert {lookalike.skeleton(s) for s in same} == {lookalike.skeleton(base)}


def test_skeleton_keeps_other_texts_apart():
    apart = ["Il", "ll", "O0", "00", "rn", "m", "cafe", "café", "Cafe", "x²", "x2", "a b", "ab", "a\nb"]
    assert len({lookalike.skeleton(s) for s in apart}) == len(apart)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_skeleton_is_stable(t):
    s = lookalike.skeleton(t)
    assert lookalike.skeleton(s) == s and lookalike.skeleton(unicodedata.normalize("NFD", t)) == s


def test_look_pairs_equal_brute_force(spark):
    rows = [(1, "abc"), (2, "аbc"), (3, "abc"), (4, "ａbc"), (5, "abd"), (6, None), (7, ""), (8, "​"), (None, "abc"), (9, LONG), (10, LONG.replace("w", "ｗ")), (10, LONG.replace("w", "ｗ"))]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, look string")
    got = {tuple(r) for r in lookalike.pairs(lookalike.look_keys(df)).collect()}
    ok = [(i, t) for i, t in dict(r for r in rows if r[0]).items() if t and lookalike.skeleton(t)]
    want = {(i, j) for i, a in ok for j, b in ok if i < j and a != b and lookalike.skeleton(a) == lookalike.skeleton(b)}
    assert got == want and (9, 10) in got and (1, 2) in got and (1, 3) not in got
    n = {r.doc_id: r.text for r in lookalike.normalized(df).collect()}
    assert n[2] == n[4] == "abc" and n[6] is None and n[7] == ""
    assert {r.n_texts for r in lookalike.classes(lookalike.look_keys(df)).where("id = 1").collect()} == {3}


def test_look_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lookalike.pairs(lookalike.look_keys(df)).count() == 0


# ---- leaks -----------------------------------------------------------------------

WORDS = [f"{a}{b}" for a in ("bra", "klo", "min", "sto", "ter") for b in ("dan", "pig", "sul", "wex", "yor")]


def subtitle(lines, step=3):
    return "".join(f"{i + 1}\n00:00:{i * step % 60:02d},000 --> 00:00:{i * step % 60 + 1:02d},000\n{x}\n\n" for i, x in enumerate(lines))


def test_spoken_drops_what_is_not_speech():
    t = subtitle(["<i>Hello there,</i>", "[door slams]", "MAYOR: my friend", "(sighs)", "♪ slow waltz ♪", "- and\r\nall"])
    assert leakage.spoken(t) == [leakage.fold_words("hello there my friend and all")]


def test_fold_joins_misread_words():
    for a, b in (("mayor", "rnayor"), ("storm", "st0rm"), ("the", "tlie"), ("waiting", "waifing"), ("lights", "iights"), ("what", "vvhat"), ("chapel", "chapcl"), ("telling", "telhng"), ("café", "cafe")):
        assert leakage.fold_words(a) == leakage.fold_words(b), (a, b)
    assert leakage.fold_words("storm") != leakage.fold_words("strom")


def test_words_count_as_written():
    w = leakage.test_words("write to a.b@post.example.org - or 345.555.0122, not later")
    assert len(w.split()) == 7 and leakage.longest_run(w.replace("_", " ").split(), w, 0, 1) == (7, 0)


def test_wrong_decoding_is_undone():
    wrong = lambda t: t.encode().decode("cp1252")
    assert leakage.spoken(wrong("el café ñ")) == leakage.spoken("el café ñ") == leakage.spoken(wrong(wrong("el café ñ")))
    assert leakage.spoken("one\n" + wrong("♪ slow waltz ♪") + "\ntwo 漢") == leakage.spoken("one\ntwo 漢")


def test_cues_out_of_order_are_read_both_ways():
    t = "2\n00:00:05,000 --> 00:00:06,000\ntwo\n\n1\n00:00:01,000 --> 00:00:02,000\none\n"
    one, two = leakage.fold_words("one"), leakage.fold_words("two")
    assert leakage.spoken(t) == [two + one, one + two]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    tests = [(f"t{i}", " ".join(rng.choice(WORDS) for _ in range(rng.choice([5, 13, 30])))) for i in range(12)] + [("none", None), ("empty", "")]
    docs = []
    for i in range(60):
        lines = [" ".join(rng.choice(WORDS) for _ in range(5)) for _ in range(6)]
        if i % 3 == 0:
            w = rng.choice(tests[:12])[1].split()
            n = rng.choice([12, 13, 20])
            at = rng.randrange(max(1, len(w) - n + 1))
            part = w[at : at + n]
            lines[3:3] = [" ".join(part[k : k + 4]) + ("!" if k else ",") for k in range(0, len(part), 4)] + ["[noise]"]
        docs.append((i, subtitle(lines), "clash"))
    docs += [(100, None, "c"), (101, "", "c"), (102, LONG, "c"), (3, docs[3][1], "c")]
    got = {(r.doc, r.item): r.run for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string, words string"), spark.createDataFrame(tests, "id string, text string"), "doc_id", "text", "id", "text").collect()}
    want = {}
    for d, t, _ in docs:
        for k, x in tests:
            w = leakage.test_words(x or "")
            if t and len(w.split()) >= 13:
                best = max(leakage.longest_run(s, w, o, 1)[0] for s in leakage.spoken(t) for o in range(-len(w), len(s) + 1))
                if best >= 13:
                    want[d, k] = best
    assert got == want and want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["aa", "bb", "cc_dd"]), min_size=1, max_size=12), st.lists(st.sampled_from(["aa", "bb", "cc", "dd"]), max_size=20), st.integers(-12, 12), st.integers(1, 5))
def test_longest_run_equals_a_plain_walk(words, doc, offset, least):
    best = run = q = 0
    for w in words:
        parts = w.split("_")
        ok = all(0 <= q + i + offset < len(doc) and doc[q + i + offset] == p for i, p in enumerate(parts))
        run = run + 1 if ok else 0
        best, q = max(best, run), q + len(parts)
    got, at = leakage.longest_run(doc, " ".join(words), offset, least)
    assert got == (best if best >= least else 0)


def test_leaks_of_nothing(spark):
    e = spark.createDataFrame([], "doc_id long, text string")
    t = spark.createDataFrame([("a", " ".join(WORDS))], "id string, text string")
    assert leakage.leaks(e, t, "doc_id", "text", "id", "text").count() == 0


# ---- containers ------------------------------------------------------------------


def test_first_fit_decreasing_equals_plain_scan():
    rng = random.Random(1)
    for _ in range(30):
        sizes = sorted((rng.randint(1, 50) for _ in range(rng.randint(0, 60))), reverse=True)
        bins, want = [], []
        for x in sizes:
            at = next((i for i, b in enumerate(bins) if b + x <= 50), len(bins))
            if at == len(bins):
                bins.append(0)
            bins[at] += x
            want.append(at)
        assert packing.first_fit_decreasing(sizes, 50) == want


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=300), st.integers(8, 40))
def test_cut_joins_to_the_text(t, capacity):
    t = t.encode("utf-8", "ignore").decode()
    enc = packing.encoder()
    parts = packing.cut(t, enc, capacity)
    assert "".join(t[a:b] for a, b, _ in parts) == t
    assert all(len(enc.encode_ordinary(t[a:b])) == n <= capacity for a, b, n in parts)


def test_containers_hold_everything_once(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 400))), 0) for i in range(300)]
    rows += [(500, None, 1), (501, "", 1), (502, LONG, 1), (503, "same", 1), (503, "same", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bin int")
    got = packing.pack_documents(df).toPandas()
    enc = packing.encoder()
    text = {i: t for i, t, _ in rows}
    assert (got.groupby(["grp", "bin"]).n_tokens.sum() <= packing.CAPACITY).all()
    assert sorted(got.id.unique()) == sorted(i for i, t, _ in rows if t) or set(got.id) == {i for i, t, _ in rows if t}
    assert (got.id == 503).sum() == 2
    for i, g in got[got.id != 503].groupby("id"):
        g = g.sort_values("piece")
        assert "".join(text[i][a:b] for a, b in zip(g.start_char, g.end_char)) == text[i]
        assert len(g) == 1 or len(enc.encode_ordinary(text[i])) > packing.CAPACITY
    used = got.n_tokens.sum() / (packing.CAPACITY * got.groupby(["grp", "bin"]).ngroups)
    assert used > 0.9
    assert packing.pack_documents(df.where("doc_id < 0")).count() == 0


# ---- personal information --------------------------------------------------------

NAMES = pii.Names({"Brivodek", "Fendekka", "Sorrel", "Kayrvin", "Marvin", "Lorvin", "Ulrvin", "Kaydekka", "Sadekka", "Maddekka", "Kaymirel", "Samirel", "Velmirel", "Brimirel"}, {"Gavmere", "Zormere", "Tarnmere", "Pellmere", "Gavwick", "Zorwick", "Tarnwick", "Pellwick"})


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("met Dr. Brivodek Gavmere today", "name", "Brivodek Gavmere"),
        ("key is with B. Gavmere, flat", "name", "B. Gavmere"),
        ("call Gavmere, Brivodek on monday", "name", "Gavmere, Brivodek"),
        ("brivodek R. gavmere-zorwick left", "name", "brivodek R. gavmere-zorwick"),
        ("write to a.b+c@mail.example now", "email", "a.b+c@mail.example"),
        ("write to ab (at) post (dot) example (dot) org.", "email", "ab (at) post (dot) example (dot) org"),
        ("write to ab at post dot example dot org now", "email", "ab at post dot example dot org"),
        ("text me (+49 (0)30 23125-411) or", "phone", "+49 (0)30 23125-411"),
        ("text me ((637) 555-0168) or", "phone", "(637) 555-0168"),
        ("it is 001 667 555 0166 ext. 61 now", "phone", "001 667 555 0166 ext. 61"),
        ("ring 07700 900 571.", "phone", "07700 900 571"),
        ("my SSN 000 23 6164 expires", "id", "000 23 6164"),
        ("resident no. 790711-0813177.", "id", "790711-0813177"),
        ("scan of NI QQ098874C sent", "id", "QQ098874C"),
        ("wants tax id 00129856534, ask", "id", "00129856534"),
        ("at 62 hazelmoor road, brennau.", "address", "62 hazelmoor road, brennau"),
        ("Lieferung an Alderkampweg 243c, bitte klingeln", "address", "Alderkampweg 243c"),
        ("to Calle Larkmere 13, 6º, Brennau\nkey", "address", "Calle Larkmere 13, 6º, Brennau"),
        ("at PO Box 104, Lissane", "address", "PO Box 104, Lissane"),
        ("Norvik-gu Inkwell-ro 29-gil 221", "address", "Norvik-gu Inkwell-ro 29-gil 221"),
    ],
)
def test_finding(text, kind, part):
    assert [(k, text[a:b]) for k, a, b in pii.find(text, NAMES)] == [(kind, part)]


@pytest.mark.parametrize("text", ["", "invoice from Gavmere Ltd, net 3 days", "the Sorrel lamp", "Gavmere & Sons", "ISBN 978-0-00-191301-2", "order 48701-494250", "measured 100-48-53", "at 2024-01-19 14:43\nthe road to X", "version @6.x", "hash 045746394e30", "USD 1,629.50", "build 2.89.572"])
def test_no_finding(text):
    assert pii.find(text, NAMES) == []


def test_long_texts_are_read_in_linear_time():
    for t in ("a" * 200_000, "1" * 200_000, "1 " * 100_000, "a.b-" * 50_000, LONG, "Gavmere " * 20_000):
        pii.find(t, NAMES)


@settings(max_examples=100, deadline=None)
@given(st.text("0123456789", min_size=1, max_size=20), st.binary(min_size=4, max_size=8))
def test_permutation_can_be_undone(d, key):
    assert pii.permute(pii.permute(d, key, "t"), key, "t", undo=True) == d


def test_permutation_is_one_to_one():
    assert len({pii.permute(f"{i:03d}", b"k") for i in range(1000)}) == 1000
    assert pii.permute_date(pii.permute_date("790711", b"k"), b"k", undo=True) == "790711"


def test_mask_changes_only_findings(spark):
    t = "met Brivodek Gavmere, ring 07700 900 571 or (637) 555-0168; 07700 900 571 again"
    m = pii.mask(t, NAMES, b"k")
    assert m.startswith("met [NAME ") and "900 571" not in m and m.count("[PHONE") == 3 and m.endswith(" again")
    p = [x.split("]")[0] for x in m.split("[PHONE ")[1:]]
    assert p[0] == p[2] != p[1] and len(p[0]) == len("07700 900 571")
    df = spark.createDataFrame([("a", t), ("b", None), ("c", ""), ("a", t), ("d", LONG)], "k string, text string")
    got = pii.findings(df, NAMES, "text", "k").groupBy("k").count().collect()
    assert {tuple(r) for r in got} == {("a", 8)}
    assert {r.k: r.text for r in pii.masked(df, NAMES, b"k", "text").collect()} == {"a": m, "b": None, "c": "", "d": LONG}
    assert pii.findings(df.where("false"), NAMES, "text", "k").count() == 0


# ---- canonical list --------------------------------------------------------------

ENTRIES = [("groceries", "groceries"), ("groceries", "Food shopping"), ("travel-plans", "travel-plans"), ("travel-plans", "trips"), ("pet-care", "Pet care"), ("insurance", "insurance"), ("tax", "fiscal stuff")]


def test_mapping(spark):
    e = spark.createDataFrame(ENTRIES, "entry string, name string")
    cases = {
        "Groceries ": "groceries", "grcris": "groceries", "Gröceries": "groceries", "grocer…": "groceries", "rgoceries": "groceries", "FOOD-shopping": "groceries",
        "plans travel": "travel-plans", "tarvel lpans": "travel-plans", "life/travel-plans": "travel-plans", "#pet_care": "pet-care", "PetCare": "pet-care", "insurnace": "insurance",
        "fiscal-stuff": "tax", "qwerty": "", "submarine": "", "???": "", "n/a": "", "x" * 5000: "",
    }
    rows = [(i, v, "clash") for i, v in enumerate([*cases, *cases, "groceries", None, "", " \t"])]
    df = spark.createDataFrame(rows, "id long, value string, entry string")
    got = [(r.value, r.entry) for r in canonical.map_values(df, e, e.select("entry"), "value").collect()]
    assert sorted(got) == sorted([*cases.items()] * 2)
    assert canonical.map_values(df.where("false"), e, e.select("entry"), "value").count() == 0
    none = spark.createDataFrame([], "entry string, name string")
    assert {r.entry for r in canonical.map_values(df, none, none.select("entry"), "value").collect()} == {""}


def test_prefix_join_equals_all_pairs(spark):
    """The filters lose no pair: best scores equal those of comparing every form."""
    values = [v for v, _ in [("grocereis", 0), ("travl", 0), ("pet car", 0), ("food", 0), ("trip", 0), ("insurances", 0), ("care pet", 0), ("shopping food", 0)]]
    e = spark.createDataFrame(ENTRIES, "entry string, name string")
    got = {r.value: (r.entry, round(r.score, 6)) for r in canonical.match(spark.createDataFrame([(v,) for v in values], "value string"), e).collect()}
    weight = {"w": 1.0, "c": 0.97, "t": 0.94, "l": 0.7}
    want = {}
    for v in values:
        best = []
        for k, f in canonical.value_forms(canonical.plain(v)):
            for entry, name in ENTRIES:
                for p in {canonical.plain(name), canonical.plain(name, False)}:
                    for k2, f2 in canonical.entry_forms(p):
                        a, b = set(canonical.grams(f, k)), set(canonical.grams(f2, k2))
                        j = len(a & b) / len(a | b)
                        if k == k2 and j >= canonical.THRESHOLD[k]:
                            best.append((-round(j * weight[k], 6), entry))
        if best:
            want[v] = (min(best)[1], -min(best)[0])
    assert got == want and len(want) >= 6


def test_canonical_ties_take_the_smaller_name(spark):
    e = spark.createDataFrame([("b", "alpha one"), ("a", "alpha one")], "entry string, name string")
    v = spark.createDataFrame([("alpha one",)], "value string")
    assert canonical.match(v, e).select(F.col("entry")).first()[0] == "a"
