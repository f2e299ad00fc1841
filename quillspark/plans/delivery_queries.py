"""Bindings of the repeated-delivery operator to the trace table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import delivery
from quillspark.session import materialise
from quillspark.sources.tables import table

#: The trace is replayed as two deliveries, split here; any split gives the same rows.
SPLIT = "2023-12-17 00:00:00"


def _msgs(spark: SparkSession, sf: str) -> DataFrame:
    """The messages of the trace, parsed once: every later step reads four narrow columns."""
    return materialise(delivery.messages(table(spark, sf, "pipeline_record")), "delivery-messages")


def _early():
    return F.col("received_at") < F.lit(SPLIT).cast("timestamp")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    m = _msgs(spark, sf)
    return delivery.repeats(m, delivery.replay(m, _early())).select("record_seq")


def p2_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Exactly one row per run."""
    k = delivery.replay(_msgs(spark, sf), _early())
    return k.select("record_seq", "producer", F.timestamp_micros("number").cast("timestamp_ntz").alias("run_at"))


def p2_seen_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The state the whole table leaves behind."""
    s = delivery.remember(delivery.accept_once(_msgs(spark, sf)))
    return s.select("producer", *(F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("block", "lo", "hi", "key")))


_MSG = """SELECT lower(trim(drop_id, ' ' || chr(9) || chr(10) || chr(13))) AS producer,
  epoch_us(try_cast(trim(ts) AS TIMESTAMPTZ)) AS number, received_at, record_seq
  FROM pipeline_record"""
_FIRST = f"""WITH m AS (SELECT * FROM ({_MSG}) WHERE producer IS NOT NULL AND number IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY producer, number ORDER BY received_at NULLS LAST, record_seq) AS rn FROM m)"""

QUERIES = {"p2_found": p2_found, "p2_kept": p2_kept, "p2_seen_ranges": p2_seen_ranges}
SQL = {
    "p2_found": f"{_FIRST} SELECT record_seq FROM r WHERE rn > 1",
    "p2_kept": f"{_FIRST} SELECT record_seq, producer, make_timestamp(number) AS run_at FROM r WHERE rn = 1",
    "p2_seen_ranges": f"""{_FIRST}, d AS (SELECT DISTINCT producer, number, number >> 30 AS block FROM m
 WHERE regexp_full_match(producer, '[0-9a-f]{{12}}')),
i AS (SELECT producer, block, number, number - row_number() OVER (PARTITION BY producer, block ORDER BY number) AS island FROM d)
SELECT producer, block, min(number) AS lo, max(number) AS hi, CAST(-1 AS BIGINT) AS key FROM i GROUP BY producer, block, island
UNION ALL SELECT DISTINCT producer, CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), number FROM m
WHERE NOT regexp_full_match(producer, '[0-9a-f]{{12}}')""",
}
