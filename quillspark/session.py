"""Session factory and the two decisions every operator shares: where durable
intermediate tables go, and whether a side is small enough to broadcast."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when a count proves it holds at most this many rows.
BROADCAST_ROWS = 200_000


def get_session(app: str = "quillspark", cores: str = "*", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUILLSPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. Only where
    that is unset and the master is local (tests) is a temporary folder chosen."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = os.path.join(tempfile.gettempdir(), f"quillspark-{spark.sparkContext.applicationId}")
    os.makedirs(made, exist_ok=True)
    return "file://" + made


_open: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    path = f"{shared_dir(spark)}/quillspark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    for made in _open[-1:]:
        made.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete at the end the intermediate tables that are made inside; what is returned
    from inside must not read them any more."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            delete(spark, path)


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; call it once results are written."""
    delete(spark, f"{shared_dir(spark)}/quillspark-{spark.sparkContext.applicationId}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once as parquet in the shared folder and read it back: cuts the
    lineage, survives lost executors, and lets several branches reuse one scan."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if at most `limit` rows exist (the count stops there);
    a larger side stays unhinted and is joined by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
