"""The driver contract: every SQL has a query, and the flagship runs."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "section" in df.columns


def test_core_queries_agree_with_their_sql(spark):
    """Row counts of every core query, at the smallest scale."""
    import glob
    import os

    import duckdb

    from quillspark.plans import registry

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    queries, sql = registry.gather()
    for name, text in sql.items():
        df = queries[name](spark, SF)
        want = c.execute(text)
        assert sorted(df.columns) == sorted(d[0] for d in want.description), name
        assert df.count() == len(want.fetchall()), name
