"""Runs that come long after newer ones, over several micro-batches, with the defaults."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.operators import delivery
from quillspark.streaming import jobs

ONCE = {"availableNow": True}
#: Files in order of arrival; the second and third bring first copies 12 and 19 days behind.
FILES = (
    [(1, "0" * 12, "2024-01-20T00:00:00Z"), (2, "bad id", "2024-01-20T00:00:00Z")],
    [(3, "0" * 12, "2024-01-08T00:00:00Z"), (4, "bad id", "2024-01-08T00:00:00Z"), (5, "0" * 12, "2024-01-20T00:00:00Z")],
    [(6, "0" * 12, "2024-01-01T00:00:00Z"), (7, "0" * 12, "2024-01-08T00:00:00Z"), (8, "bad id", "2024-01-08T00:00:00Z")],
    [(9, "0" * 12, "2024-01-01T00:00:00Z"), (10, "1" * 12, "2024-01-21T00:00:00Z"), (11, "1" * 12, "2024-01-21T00:00:00Z")],
)
FIRST = [1, 2, 3, 4, 6, 10]


@pytest.fixture
def late(spark, tmp_path):
    schema = "record_seq long, drop_id string, ts string, blocked_reason string, received_at timestamp"
    for i, rows in enumerate(FILES):
        df = spark.createDataFrame([(*r, None, datetime(2024, 2, 1, i, r[0])) for r in rows], schema)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return s.withColumn("at", delivery.instant(F.col("ts"))).where("at is not null")


def test_late_first_copies_are_kept(spark, late, tmp_path):
    q = jobs.delivered_once(late).select("producer", F.unix_micros("at").alias("number")).writeStream.format("memory").queryName("late_once")
    q.option("checkpointLocation", str(tmp_path / "cp")).trigger(**ONCE).start().awaitTermination(120)
    got = sorted((r.producer, r.number) for r in spark.table("late_once").collect())
    assert got == sorted({(d, int(datetime.fromisoformat(ts).timestamp() * 1e6)) for rows in FILES for _, d, ts in rows})


def test_accepted_by_ranges(spark, late, tmp_path):
    q = jobs.to_accepted(late, str(tmp_path / "out"), str(tmp_path / "cp"), ONCE)
    q.awaitTermination(120)
    assert q.lastProgress["batchId"] == 3 and sorted(p.name for p in (tmp_path / "out/seen").iterdir()) == ["2", "3"]
    assert sorted(r.record_seq for r in spark.read.parquet(str(tmp_path / "out/accepted")).collect()) == FIRST


def test_late_days_are_counted(late, tmp_path):
    days = {}
    q = jobs.daily_counts(late).writeStream.outputMode("update").foreachBatch(lambda b, _: days.update({r.day: r.runs for r in b.collect()}))
    q.option("checkpointLocation", str(tmp_path / "cp")).trigger(**ONCE).start().awaitTermination(120)
    assert days == {"2024-01-20": 3, "2024-01-08": 4, "2024-01-01": 2, "2024-01-21": 2}
