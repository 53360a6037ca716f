"""Time arithmetic in whole microseconds, and time chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helmtrace.functions.geo import col

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def micros(ts) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def hours_between(start, end) -> Column:
    return (micros(end) - micros(start)) / F.lit(float(HOUR_US))


def minutes_between(start, end) -> Column:
    return (micros(end) - micros(start)) / F.lit(60_000_000.0)


def chunk_of(ts, width_us: int = HOUR_US) -> Column:
    """Number of the fixed-width time chunk a timestamp lies in."""
    us = micros(ts)
    return ((us - F.pmod(us, F.lit(width_us))) / F.lit(width_us)).cast("long")


def whole_days_plus_one(first, last) -> Column:
    return (F.floor((micros(last) - micros(first)) / F.lit(float(DAY_US))) + 1).cast("long")


def weekday_name(ts) -> Column:
    return F.date_format(col(ts), "EEEE")


def overnight_hours(ts, start: int, end: int) -> Column:
    """Hour filter; ``start >= end`` spans midnight."""
    hour = F.hour(col(ts))
    if start < end:
        return (hour >= start) & (hour < end)
    return (hour >= start) | (hour < end)


def date_from_name(name) -> Column:
    """``…/2024-01-05.csv``, ``ais-2024-01-05.parquet`` or ``AIS_2024_01_05.csv`` to a date, else null."""
    base = F.regexp_extract(col(name), r"([^/]+)$", 1)
    dashed = F.regexp_extract(base, r"^(?:ais-)?(\d{4}-\d{2}-\d{2})\.(?:csv|parquet)$", 1)
    under = F.replace(F.regexp_extract(base, r"^AIS_(\d{4}_\d{2}_\d{2})\.(?:csv|parquet)$", 1), F.lit("_"), F.lit("-"))
    text = F.when(dashed != "", dashed).when(under != "", under)
    return F.try_to_date(text, "yyyy-MM-dd")
