"""Streams run to the end over files and agree with the batch operators."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.operators import delivery
from quillspark.operators.mirror import PageStore
from quillspark.streaming import jobs

ONCE = {"availableNow": True}


def run(df, tmp_path, mode="append", name="out"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(**ONCE).start().awaitTermination(120)
    return df.sparkSession.table(name)


@pytest.fixture
def traces(spark, tmp_path):
    rows = [(i, f"{i % 40:012x}", f"2024-01-{1 + i % 9:02d}T00:00:00Z", "x" if i % 5 == 0 else None, datetime(2024, 1, 1)) for i in range(100)] + [(200, "a", "junk", None, None)]
    df = spark.createDataFrame(rows, "record_seq long, drop_id string, ts string, blocked_reason string, received_at timestamp")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    return df, jobs.trace_stream(spark, str(tmp_path / "in"), df.schema)


def test_daily_counts(traces, tmp_path):
    df, s = traces
    got = {tuple(r) for r in run(jobs.daily_counts(s), tmp_path, "complete", "daily").collect()}
    want = df.withColumn("d", F.substring("ts", 1, 10)).where("ts <> 'junk'").groupBy("d").agg(F.count("*"), F.count_if(F.length("blocked_reason") > 0))
    assert got == {tuple(r) for r in want.collect()}


def test_delivered_once(traces, tmp_path):
    df, s = traces
    got = run(jobs.delivered_once(s, "40 days").select("producer", F.unix_micros("at").alias("number")), tmp_path, name="once")
    want = delivery.accept_once(delivery.messages(df)).select("producer", "number")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_cooldown(spark, tmp_path):
    spark.createDataFrame([("u", s * 1_000_000) for s in (0, 4, 9, 10, 15, 21)], "u string, us long").coalesce(1).write.parquet(str(tmp_path / "c"))
    s = spark.readStream.schema("u string, us long").parquet(str(tmp_path / "c"))
    got = run(jobs.cooldown(s, "u", "us", 10), tmp_path, name="cool").orderBy("us")
    assert [r.ok for r in got.collect()] == [True, False, False, True, False, True]


def test_pending_is_taken_once(spark, tmp_path):
    rows = [("a", "put", 0), ("a", "pop", 5), ("a", "pop", 6), ("b", "put", 0), ("b", "pop", 300_000_001), ("c", "pop", 1)]
    spark.createDataFrame(rows, "token string, action string, us long").coalesce(1).write.parquet(str(tmp_path / "p"))
    s = spark.readStream.schema("token string, action string, us long").parquet(str(tmp_path / "p"))
    got = run(jobs.pending(s, "token"), tmp_path, name="pend")
    assert sorted(map(tuple, got.collect())) == [("a", "missing"), ("a", "taken"), ("b", "missing"), ("c", "missing")]


def test_queue_to_store_is_exactly_once(spark, tmp_path):
    q = tmp_path / "q"
    q.mkdir()
    for name in ("queue-1-ab.md", "queue-2-cd.md", "queue-x-ef.md", "other.md"):
        (q / name).write_text(f"body of {name}")
    store = PageStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        s = jobs.queue_stream(spark, str(q)).select(F.concat(F.lit("daily/"), "name").alias("path"), F.col("text").alias("content"))
        jobs.to_store(s, store, str(tmp_path / "cp"), ONCE).awaitTermination(120)
    assert sorted(r.path for r in store.read().collect()) == ["daily/queue-1-ab.md", "daily/queue-2-cd.md"]
    assert store.versions() == [1]


def test_the_newest_content_of_a_batch_is_stored(spark, tmp_path):
    src = tmp_path / "src"
    spark.createDataFrame([("p", "z first", 1), ("p", "a later", 2), ("q", "once", 1)], "path string, content string, seq int").write.parquet(str(src))
    store = PageStore(spark, str(tmp_path / "store"))
    changes = spark.readStream.schema("path string, content string, seq int").parquet(str(src))
    jobs.to_store(changes, store, str(tmp_path / "cp"), ONCE, order="seq").awaitTermination(120)
    assert {tuple(r) for r in store.read().collect()} == {("p", "a later"), ("q", "once")}


def test_two_pass(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, escalated boolean")
    stage = jobs.two_pass(lambda d: d.withColumn("by", F.lit("low")), lambda d: d.withColumn("by", F.lit("mid")))
    assert {(r.id, r.by) for r in stage(df).collect()} == {(1, "mid"), (2, "low"), (3, "low")}
