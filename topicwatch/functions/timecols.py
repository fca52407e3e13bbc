"""Time column helpers. Timestamps stay TIMESTAMP_NTZ so no session time
zone leaks into results."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_ntz(ts: str | _dt.datetime | Column) -> Column:
    if isinstance(ts, Column):
        return ts
    if isinstance(ts, _dt.datetime):
        ts = ts.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.to_timestamp_ntz(F.lit(ts))


def minus(ts: Column, *, days: float = 0, hours: float = 0, minutes: float = 0, seconds: float = 0) -> Column:
    secs = days * 86400 + hours * 3600 + minutes * 60 + seconds
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(secs).cast("decimal(18,6)"))


def plus_seconds(ts: Column, secs: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs.cast("decimal(18,6)"))


def hour_start(ts: Column) -> Column:
    """Clock hour of a timestamp, as TIMESTAMP_NTZ (date_trunc would return a
    session-zone TIMESTAMP)."""
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.lit(0), F.lit(0))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end (NTZ-safe)."""
    return F.timestamp_diff("SECOND", start, end)


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


# Fixed preset windows of the dashboard filters (F-10).
PRESET_SECONDS = {"1h": 3600, "6h": 6 * 3600, "24h": 86400, "7d": 7 * 86400,
                  "14d": 14 * 86400, "30d": 30 * 86400}


def in_preset(ts: Column, now: Column, preset: str) -> Column:
    """F-10: ``ts >= now - preset``; 'all' is always true."""
    if preset == "all":
        return F.lit(True)
    return ts >= minus(now, seconds=PRESET_SECONDS[preset])


def in_custom_days(ts: Column, start_date: str, end_date: str) -> Column:
    """F-10 custom range: whole days, start 00:00 through end 23:59:59.999999
    (half-open on the next day)."""
    return (ts >= as_ntz(f"{start_date} 00:00:00")) & (
        ts < as_ntz(f"{end_date} 00:00:00") + F.make_dt_interval(F.lit(1)))


def age_label(ts: Column, now: Column) -> Column:
    """F-14 ``format_timestamp``: Just now / Nm ago / Nh ago / Yesterday /
    Nd ago / date."""
    s = F.timestamp_diff("SECOND", ts, now)
    d = F.floor(s / 86400).cast("bigint")
    return (F.when(s < 60, "Just now")
            .when(s < 3600, F.concat(F.floor(s / 60).cast("bigint").cast("string"), F.lit("m ago")))
            .when(s < 86400, F.concat(F.floor(s / 3600).cast("bigint").cast("string"), F.lit("h ago")))
            .when(d == 1, "Yesterday")
            .when(d < 7, F.concat(d.cast("string"), F.lit("d ago")))
            .otherwise(F.date_format(ts, "yyyy-MM-dd")))


def in_quiet_hours(ts: Column, start: Column, end: Column) -> Column:
    """S-17: hour in [start, end), wrapping when start > end; start == end is
    never quiet; NULL bounds are never quiet."""
    h = F.hour(ts)
    return (F.when(start.isNull() | end.isNull() | (start == end), F.lit(False))
            .when(start < end, (h >= start) & (h < end))
            .otherwise((h >= start) | (h < end)))
