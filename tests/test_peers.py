"""Peers of every page, against the plain loop."""

import pyarrow.parquet as pq

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


def test_every_page_is_a_query(spark):
    newest = {}
    for r in pq.read_table(f"{SF}/index_entry.parquet", columns=["slug", "entry_id", "tags", "entry_date"]).to_pylist():
        if r["tags"]:
            at = (r["entry_date"] is not None, r["entry_date"] or 0, r["entry_id"])
            if r["slug"] not in newest or newest[r["slug"]][0] < at:
                newest[r["slug"]] = (at, {t for t in r["tags"] if t is not None})
    want = set()
    for slug, (_, t) in newest.items():
        best = sorted((-len(t & u), s) for s, (_, u) in newest.items() if s != slug and t & u)[:5]
        want |= {(slug, s, -n, i) for i, (n, s) in enumerate(best, 1)}
    got = [(r.slug, r.peer, r.overlap, r.place) for r in entry.queries()["tag_peers_all"](spark, SF).collect()]
    assert len({r[0] for r in want}) > 100 and sorted(got) == sorted(want)
