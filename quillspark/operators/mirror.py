"""Mirror and versioned page store."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def upsert(source: DataFrame, backup: DataFrame) -> DataFrame:
    """(path, content): all source pages and the backup pages the source lacks; deletions
    never reach the backup."""
    gone = backup.join(source.select("path"), "path", "left_anti")
    return source.select("path", "content").unionByName(gone.select("path", "content"))


def verify(source: DataFrame, backup: DataFrame, critical: str, most_percent: float = 5.0) -> DataFrame:
    """One row: counts, their difference in percent, and the verdict."""
    sides = source.select("path", F.lit(0).alias("side")).unionByName(backup.select("path", F.lit(1).alias("side")))
    has = lambda side: (F.col("side") == side) & (F.col("path") == critical)
    j = sides.agg(*(F.count_if(F.col("side") == i).alias(f"n_{n}") for i, n in enumerate(("source", "backup"))), *(F.count_if(has(i)).alias(f"n_{n}_critical") for i, n in enumerate(("source", "backup"))))
    delta = F.abs(F.col("n_source") - F.col("n_backup")) * 100.0 / F.greatest("n_source", F.lit(1))
    verdict = F.when(F.col("n_backup") == 0, "empty").when(F.col("delta_percent") > most_percent, "count_differs").when((F.col("n_source_critical") > 0) & (F.col("n_backup_critical") == 0), "critical_missing").otherwise("ok")
    return j.withColumn("delta_percent", delta).withColumn("verdict", verdict).drop("n_source_critical", "n_backup_critical")


class ConflictError(RuntimeError):
    pass


class PageStore:
    """Versions of a page table in a folder all executors share.

    A commit writes every page of a change to a staging folder, claims the next version
    number by creating a file that must not exist yet, and makes the change visible by one
    rename, so readers see all of it or nothing and no two writers get one number. The
    change id lies inside the version; a commit with a known id is a no-op. A number whose
    writer died stays empty. snapshot() writes the newest content of all pages, after which
    older versions are not read any more."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, mark: str) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)))
        return sorted(int(n[2:]) for n in names if n.startswith(mark))

    def versions(self) -> list[int]:
        return self._numbers("v=")

    def _version_of(self, change_id: str) -> int | None:
        found = self._fs.globStatus(self._path(f"{self.root}/v=*/_id-{change_id}")) or []
        return min((int(f.getPath().getParent().getName()[2:]) for f in found), default=None)

    def _claim(self, n: int) -> bool:
        """True if this writer, and no other, gets version n."""
        p = self._path(f"{self.root}/_claims/{n:012d}")
        jvm = self.spark.sparkContext._jvm
        try:
            self._fs.mkdirs(p.getParent())
            if self._fs.getScheme() == "file":  # Hadoop's local create is no atomic one
                jvm.java.nio.file.Files.createFile(jvm.java.io.File(p.toUri().getPath()).toPath(), self.spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
            else:
                self._fs.create(p, False).close()
            return True
        except Exception as e:  # a Java exception of the one who came later
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise

    def commit(self, changes: DataFrame, change_id: str, retries: int = 3) -> int | None:
        """Version of the change (path, content); None if there is nothing to write. A number
        that another writer claims first is left to it, and the next is tried."""
        if changes.isEmpty():
            return None
        if known := self._version_of(change_id):
            return known
        staged = f"{self.root}/_staged-{change_id}-{uuid.uuid4().hex[:8]}"
        changes.select("path", "content").write.parquet(staged)
        self._fs.create(self._path(f"{staged}/_id-{change_id}"), True).close()
        for _ in range(retries):
            n = max([*self.versions(), *(int(s.getPath().getName()) for s in self._fs.globStatus(self._path(f"{self.root}/_claims/*")) or []), 0]) + 1
            if self._claim(n):
                if known := self._version_of(change_id):  # the same change, by another writer
                    self._fs.delete(self._path(staged), True)
                    return known
                if self._fs.rename(self._path(staged), self._path(f"{self.root}/v={n:012d}")):
                    return n
        self._fs.delete(self._path(staged), True)
        raise ConflictError(f"change {change_id} was overtaken {retries} times")

    def _newest(self, upto: int | None = None) -> tuple[DataFrame, int]:
        versions = [v for v in self.versions() if upto is None or v <= upto]
        base = max((s for s in self._numbers("s=") if upto is None or s <= upto), default=0)
        folders = [f"{self.root}/s={base:012d}"] * bool(base) + [f"{self.root}/v={v:012d}" for v in versions if v > base]
        rows = self.spark.read.schema("path string, content string").parquet(*folders)
        rows = rows.withColumn("_v", F.regexp_extract(F.col("_metadata.file_path"), r"/[vs]=(\d+)/", 1).cast("long"))
        return rows.groupBy("path").agg(F.max_by("content", "_v").alias("content")), max([base, *versions])

    def read(self) -> DataFrame:
        """Newest content of every page."""
        return self._newest()[0]

    def snapshot(self, upto: int | None = None) -> int:
        """Write the newest content of all pages up to a version (the newest), which readers
        then start from; returns that version."""
        pages, n = self._newest(upto)
        if n not in self._numbers("s="):
            staged = f"{self.root}/_snapshot-{uuid.uuid4().hex[:8]}"
            pages.write.parquet(staged)
            self._fs.rename(self._path(staged), self._path(f"{self.root}/s={n:012d}"))
        return n


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Append-only log; row order within a call is not kept."""
    rows.write.mode("append").json(path)


def append_shielded(rows: DataFrame, path: str) -> bool:
    """append_jsonl that never fails its caller: an error is logged and False returned."""
    try:
        append_jsonl(rows, path)
        return True
    except Exception:
        log.warning("the trace could not be appended to %s", path, exc_info=True)
        return False
