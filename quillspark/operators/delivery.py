"""Messages delivered more than once: keep exactly one copy of each.

A message is a (producer, number) pair. Well-formed producers are tracked as
disjoint ranges of seen numbers; malformed ones by exact keyed lookup. A run of
the trace has producer = drop_id (trimmed, lower case) and number = its instant ts
in microseconds. Numbers are cut into blocks of 2**BLOCK_BITS so that the ranges
of one hot producer spread over many tasks.

Defined results: rows whose producer is null or whose number is null are not
messages, they are neither kept nor repeats; a null received_at sorts last; a null
row id can be neither kept nor reported. Empty input gives empty output. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import materialise

#: 2**30 microseconds, about 18 minutes, per block of a producer's numbers.
BLOCK_BITS = 30
WELL_FORMED = "^[0-9a-f]{12}$"
BLANKS = " \t\r\n "


def instant(text: Column) -> Column:
    """ISO-8601 text (date, T or blank, time with seconds, any fraction and offset notation)
    as TIMESTAMP; anything else gives null. Without an offset the instant is UTC. The
    shape is checked by single characters, which stays in generated code."""
    t = F.trim(text)
    at = lambda i: F.substring(t, i, 1)
    shaped = F.length(t).between(19, 40) & (at(5) == "-") & (at(8) == "-") & at(11).isin("T", "t", " ") & (at(14) == ":") & (at(17) == ":")
    return F.when(shaped, F.try_to_timestamp(F.translate(F.upper(t), ",", ".")))


def messages(trace: DataFrame) -> DataFrame:
    """(producer, number, received_at, record_seq) of the trace rows that are messages."""
    return trace.select(
        F.lower(F.trim(F.col("drop_id"), F.lit(BLANKS))).alias("producer"),
        F.unix_micros(instant(F.col("ts"))).alias("number"),
        F.col("received_at"),
        F.col("record_seq"),
    ).where("producer is not null and number is not null and record_seq is not null")


def _block(number: Column) -> Column:
    return F.shiftright(number, BLOCK_BITS)


def first_copies(msgs: DataFrame) -> DataFrame:
    """One row per (producer, number): its earliest copy. The minimum combines before
    the shuffle, so one message may be repeated without bound."""
    order = F.struct(F.col("received_at").isNull().alias("late"), "received_at", "record_seq")
    return (
        msgs.groupBy("producer", "number")
        .agg(F.min(order).alias("o"))
        .select("producer", "number", F.col("o.received_at").alias("received_at"), F.col("o.record_seq").alias("record_seq"))
    )


def ranges_of(numbers: DataFrame) -> DataFrame:
    """Disjoint maximal ranges (producer, block, lo, hi) that cover distinct
    (producer, number) rows: gaps and islands inside each block."""
    w = Window.partitionBy("producer", "block").orderBy("number")
    return (
        numbers.select("producer", _block(F.col("number")).alias("block"), "number")
        .withColumn("island", F.col("number") - F.row_number().over(w))
        .groupBy("producer", "block", "island")
        .agg(F.min("number").alias("lo"), F.max("number").alias("hi"))
        .drop("island")
    )


def merge_ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two range sets, overlapping and adjoining ranges merged."""
    w = Window.partitionBy("producer", "block").orderBy("lo", "hi")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    u = a.select("producer", "block", "lo", "hi").unionByName(b.select("producer", "block", "lo", "hi"))
    starts = u.withColumn("new", (F.coalesce(F.max("hi").over(before) + 1 < F.col("lo"), F.lit(True))).cast("int"))
    return (
        starts.withColumn("r", F.sum("new").over(w))
        .groupBy("producer", "block", "r")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("r")
    )


def uncovered(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates whose number no seen range of its producer covers. Ranges and
    candidates of a block are merged in one sort; the covering range, if any, is the
    one with the greatest start so far."""
    w = Window.partitionBy("producer", "block").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    cols = candidates.columns
    points = candidates.select(_block(F.col("number")).alias("block"), F.col("number").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("hi"), *cols)
    bounds = seen.select("producer", "block", F.col("lo").alias("at"), F.lit(0).alias("kind"), "hi")
    both = points.unionByName(bounds, allowMissingColumns=True).withColumn("reach", F.max("hi").over(w))
    return both.where("kind = 1 and (reach is null or reach < at)").select(*cols)


def accept_once(msgs: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The accepted copies of one batch: of each message its earliest row, unless an
    earlier batch holds it. `seen` has the accepted messages of earlier batches as
    ranges of well-formed producers (hi, lo, block) and, with null bounds, as keys of
    malformed ones (see remember)."""
    first = first_copies(msgs)
    if seen is None:
        return first
    well = F.col("producer").rlike(WELL_FORMED)
    sequenced = uncovered(first.where(well), seen.where("key is null"))
    keys = seen.where("key is not null").select("producer", F.col("key").alias("number"))
    return sequenced.unionByName(first.where(~well).join(keys, ["producer", "number"], "left_anti"))


def remember(kept: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """State (producer, block, lo, hi, key) after a batch: merged disjoint ranges for
    well-formed producers, exact keys for malformed identifiers."""
    well = F.col("producer").rlike(WELL_FORMED)
    ranges = ranges_of(kept.where(well))
    keys = kept.where(~well).select("producer", F.col("number").alias("key"))
    if seen is not None:
        ranges = merge_ranges(seen.where("key is null"), ranges)
        keys = keys.unionByName(seen.where("key is not null").select("producer", "key"))
    return ranges.withColumn("key", F.lit(None).cast("long")).unionByName(keys, allowMissingColumns=True)


def replay(msgs: DataFrame, cut: Column) -> DataFrame:
    """Accepted copies of two successive deliveries: rows before `cut` (boolean), then
    the rest against the ranges the first left. As deliveries are in received order,
    the earliest copy of every message is the accepted one."""
    early = materialise(accept_once(msgs.where(F.coalesce(cut, F.lit(False)))), "delivery-early")
    late = accept_once(msgs.where(~F.coalesce(cut, F.lit(False))), remember(early))
    return early.unionByName(late)


def repeats(msgs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every message row that is not the accepted copy: an anti join on the unique row
    id, which no hot message can skew."""
    return msgs.select("record_seq").join(kept.select("record_seq"), "record_seq", "left_anti")
