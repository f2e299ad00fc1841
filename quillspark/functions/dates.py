"""Column functions over dates, ages and interval texts. `now` is always a parameter."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_days(ts: Column, now: Column) -> Column:
    """Whole days since an instant, rounded down (also for the future)."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 86400)


def last_monday(ts: Column) -> Column:
    """Monday of the week in report: a Monday before 22:00 still reports the week before."""
    d = F.to_date(ts)
    back = F.weekday(d) + F.when((F.weekday(d) == 0) & (F.hour(ts) < 22), 7).otherwise(0)
    return F.date_sub(d, back)


def week_label_w(d: Column) -> Column:
    """Year and Monday-based week of the year, 00 before the first Monday."""
    w = F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7)
    return F.concat(F.year(d).cast("string"), F.lit("-W"), F.lpad(w.cast("string"), 2, "0"))


def week_label_iso(d: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def relative_time(ts: Column, now: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(ts)
    ago = lambda n, u: F.concat(F.floor(n).cast("string"), F.lit(u + " ago"))
    return (
        F.when(ts.isNull(), "—").when(s < 60, "just now").when(s < 3600, ago(s / 60, "m")).when(s < 86400, ago(s / 3600, "h"))
        .when(s < 2 * 86400, "yesterday").when(s < 30 * 86400, ago(s / 86400, "d")).otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )


def deadline_label(deadline: Column, now: Column) -> Column:
    """Struct (label, level) of the whole days left, rounded down."""
    n = F.floor((F.unix_timestamp(deadline) - F.unix_timestamp(now)) / 86400)
    plus = F.concat(F.lit("+"), n.cast("string"), F.lit("d"))
    label = F.when(n.isNull(), "—").when(n < 0, F.concat(F.lit("overdue "), (-n).cast("string"), F.lit("d"))).otherwise(plus)
    level = F.when(n.isNull(), "ok").when(n <= 7, "urgent").when(n <= 30, "warn").otherwise("ok")
    return F.struct(label.alias("label"), level.alias("level"))


def decay(confidence: Column, last: Column, now: Column, high: int = 30, medium: int = 90) -> Column:
    """One step down once a claim has not been confirmed for too long."""
    d = age_days(last, now)
    return F.when((confidence == "high") & (d > high), "medium").when((confidence == "medium") & (d > medium), "low").otherwise(confidence)


def duration_hours(text: Column, default: int = 24) -> Column:
    """'24h', '7d', '1w' or a bare number as hours; else, and below one, the default."""
    token = F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*(\S+)", 1))
    n = F.regexp_extract(token, r"^([+-]?\d{1,9})[hdw]?$", 1).try_cast("long")
    h = n * F.when(token.endswith("d"), 24).when(token.endswith("w"), 168).otherwise(1)
    return F.when(h >= 1, h).otherwise(default)


def parse_since(text: str) -> timedelta | None:
    """'7d', '24h' or '1w' on the driver, for literals in filters; None if unreadable."""
    m = re.fullmatch(r"(\d+)([hdw])", text.strip().lower())
    return timedelta(hours=int(m[1]) * {"h": 1, "d": 24, "w": 168}[m[2]]) if m else None
