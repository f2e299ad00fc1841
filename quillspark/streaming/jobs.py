"""Structured Streaming forms of the polling, claiming and stateful operators.

Sources are file streams; triggers are given by the caller (availableNow in tests,
processingTime='120 seconds' in service). Every sink is idempotent by batch id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.operators import delivery
from quillspark.operators.delivery import BLANKS, instant
from quillspark.operators.mirror import PageStore

SEEN_SCHEMA = "producer string, block long, lo long, hi long, key long"
ACCEPTED_SCHEMA = "producer string, number long, received_at timestamp, record_seq long"


def queue_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """Queue files queue-<digits>-<id>.md as (name, text, captured), each once: the
    source's own log in the checkpoint is the claim."""
    s = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "queue-*.md").option("maxFilesPerTrigger", per_trigger).load(folder)
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    return s.select(name.alias("name"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("captured")).where(F.col("name").rlike(r"^queue-\d+-\w+\.md$"))


def trace_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Trace rows of parquet files as they arrive, with the instant `at`."""
    t = spark.readStream.schema(schema).parquet(folder)
    return t.withColumn("at", instant(F.col("ts"))).where("at is not null")


def _bounded(traces: DataFrame, late: str | None) -> DataFrame:
    return traces if late is None else traces.withWatermark("at", late)


def daily_counts(traces: DataFrame, late: str | None = None) -> DataFrame:
    """Runs per day of the run. All runs count, however late, in update and complete mode;
    with `late` (which append mode needs) days older than that are final, and runs that
    come later than that are lost."""
    d = _bounded(traces, late).groupBy(F.window("at", "1 day").alias("w"))
    return d.agg(F.count("*").alias("runs"), F.count_if(F.length("blocked_reason") > 0).alias("blocked")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "runs", "blocked")


def delivered_once(traces: DataFrame, late: str | None = None) -> DataFrame:
    """One copy of each run, of the first trigger that holds one. The state has the exact key
    of every run and only grows; with `late` it is bounded to that time, and runs that come
    later than that are lost, their first copies too. to_accepted keeps ranges instead."""
    p = traces.withColumn("producer", F.lower(F.trim(F.col("drop_id"), F.lit(BLANKS)))).where("producer is not null")
    return p.dropDuplicates(["producer", "at"]) if late is None else _bounded(p, late).dropDuplicatesWithinWatermark(["producer", "at"])


def to_accepted(traces: DataFrame, folder: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Write the accepted copy of each message (see delivery.accept_once), however late it
    comes, to folder/accepted/batch=<id>. The seen ranges and keys after each batch lie in
    folder/seen, where the last two are kept, so that a repeated batch starts from the same
    ones. Every batch rewrites them. Folder and checkpoint belong together."""

    def accept(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = spark.read.schema(SEEN_SCHEMA).parquet(f"{folder}/seen/{batch_id - 1}") if batch_id else None
        delivery.accept_once(delivery.messages(batch), seen).write.mode("overwrite").parquet(f"{folder}/accepted/batch={batch_id}")
        kept = spark.read.schema(ACCEPTED_SCHEMA).parquet(f"{folder}/accepted/batch={batch_id}")
        delivery.remember(kept, seen).write.mode("overwrite").parquet(f"{folder}/seen/{batch_id}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/seen/{batch_id - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return traces.writeStream.foreachBatch(accept).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def cooldown(calls: DataFrame, key: str, micros: str, seconds: float) -> DataFrame:
    """(key, micros, ok) with one accepted time of state per key; the calls of a trigger
    are taken in time order, and a key idle for the cooldown is forgotten."""
    limit = int(seconds * 1e6)

    def walk(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(micros)
        ok = []
        for t in rows[micros]:
            good = last is None or t - last >= limit
            last = t if good else last
            ok.append(good)
        state.update((int(last),))
        state.setTimeoutDuration(max(1000, int(seconds * 1000)))
        yield pd.DataFrame({key: k[0], micros: rows[micros].to_numpy(), "ok": ok})

    kind = dict(calls.dtypes)
    return calls.groupBy(key).applyInPandasWithState(walk, f"{key} {kind[key]}, {micros} long, ok boolean", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def pending(events: DataFrame, key: str, seconds: float = 300.0) -> DataFrame:
    """(token, action): calls put with action 'put' and taken once with 'pop'; a pop of an
    unknown, taken or expired token gives 'missing'. Order within a trigger is by `us`."""

    def walk(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        expires = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(frames)).sort_values("us").itertuples():
            if r.action == "put":
                expires = r.us + int(seconds * 1e6)
            else:
                out.append("taken" if expires is not None and r.us < expires else "missing")
                expires = None
        if expires is None:
            if state.exists:
                state.remove()
        else:
            state.update((int(expires),))
            state.setTimeoutDuration(max(1000, int(seconds * 1000)))
        yield pd.DataFrame({key: [k[0]] * len(out), "action": out})

    kind = dict(events.dtypes)
    return events.groupBy(key).applyInPandasWithState(walk, f"{key} {kind[key]}, action string", "expires long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def to_store(changes: DataFrame, store: PageStore, checkpoint: str, trigger: dict, name: str = "pages", order: str | None = None) -> StreamingQuery:
    """Commit every micro-batch of (path, content, ...) as one atomic change, once. Of several
    contents of a page the one that is last in `order` (a column such as `captured`) is
    written; without an order a page must come once per batch, else the query stops."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        if order is None:
            once = F.when(F.count("*") > 1, F.raise_error(F.lit("a page came twice in a batch, and no order column is given")).cast("string")).otherwise(F.max("content"))
            newest = batch.groupBy("path").agg(once.alias("content"))
        else:
            newest = batch.groupBy("path").agg(F.max_by("content", order).alias("content"))
        store.commit(newest, f"{name}{batch_id}")

    return changes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def two_pass(first: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Stage that sends the rows the first pass escalates through the second."""

    def stage(rows: DataFrame) -> DataFrame:
        r = first(rows)
        done = r.where(~F.coalesce("escalated", F.lit(False)))
        return done.unionByName(second(r.where(F.coalesce("escalated", F.lit(False)))))

    return stage
