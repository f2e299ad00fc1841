"""Cooldown gate: a call is accepted if the last accepted call of its key is at least
`seconds` old; a rejected call does not restart the clock."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Clock:
    """Walks calls in (run, time) order across batches and says which are accepted."""

    def __init__(self, micros: int):
        self.micros, self.run, self.last = micros, None, 0

    def accept(self, run: tuple, at: int) -> bool:
        ok = run != self.run or at - self.last >= self.micros
        if ok:
            self.run, self.last = run, at
        return ok


def cooldown(calls: DataFrame, key: str, ts: str, tie: str, seconds: float) -> DataFrame:
    """calls with `ok`. After a pause of the whole cooldown the next call is always
    accepted, so a key's calls are cut there into independent runs, which are spread
    over all tasks and walked in time order with one call of state, never gathered.
    Null keys and times are left out; equal times go by `tie`;
    columns named ok, _us and _run are replaced."""
    calls = calls.drop("ok", "_us", "_run")
    order = Window.partitionBy(key).orderBy(ts, tie)
    micros = int(seconds * 1e6)
    c = calls.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    gap = F.col("_us") - F.lag("_us").over(order) < micros
    c = c.withColumn("_run", F.sum(F.when(gap, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clock = Clock(micros)
        for b in batches:
            ok = [clock.accept((k, r), t) for k, r, t in zip(b[key], b["_run"], b["_us"], strict=True)]
            yield b.drop(columns=["_us", "_run"]).assign(ok=ok)

    kind = ", ".join(f"`{n}` {t}" for n, t in calls.dtypes)
    return c.repartition(key, "_run").sortWithinPartitions(key, "_run", "_us", tie).mapInPandas(walk, f"{kind}, ok boolean")


def live(calls: DataFrame, at: str, now: Column, seconds: int, taken: Column) -> DataFrame:
    """Calls that were put at `now` or before, have not expired (a call that is `seconds` old
    has) and are not taken; null times are left out."""
    return calls.where((F.col(at) <= now) & (F.col(at) + F.make_dt_interval(secs=F.lit(seconds)) > now) & ~taken)
