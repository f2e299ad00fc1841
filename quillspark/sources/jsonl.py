"""JSON-lines traces, tolerant of bad lines, and strict fixture files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE_SCHEMA = (
    "ts string, drop_id string, duration_ms double, stages array<string>, escalated boolean, blocked_reason string, "
    "target_kind string, slug string, drop_type string, target_path string, target_confidence string, verifier_ok boolean, "
    "provider string, model_tier_usage map<string,bigint>, stage_latency_ms map<string,double>"
)


def parse(line: Column, schema: str = TRACE_SCHEMA) -> Column:
    """Struct of a line; null where it is no JSON object."""
    return F.when(F.trim(line).startswith("{") & F.trim(line).endswith("}"), F.from_json(line, schema, {"mode": "PERMISSIVE"}))


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """All readable rows of trace files. A row without a time is not a trace row."""
    t = spark.read.text(path).select(parse(F.col("value")).alias("r")).where("r is not null").select("r.*")
    return t.where("ts is not null")


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fixture files: any bad line or missing id stops the query; // lines are comments. Dated
    audit files (harvested-*) are left out, as what was accepted of them lies elsewhere."""
    text = spark.read.text(path).where(~F.element_at(F.split("_metadata.file_path", "/"), -1).startswith("harvested-"))
    text = text.where(~F.trim("value").startswith("//") & (F.trim("value") != ""))
    rows = text.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return rows.where(F.coalesce(F.col("id"), F.raise_error(F.lit("fixture without id")).cast("string")).isNotNull())
