"""Vessels of every date as theta sketches: distinct counts and set changes of any range without reading pings again.

The table of sets has one row per date. A sketch keeps up to ``2 ** lg_entries`` hashes: below that many vessels all
counts are exact; beyond, a count of a union is off by about ``1 / sqrt(2 ** lg_entries)`` of itself (one standard error),
and one of a difference or an intersection by that share of the union of both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 16,384 hashes (128 KB) a date: a standard error of 0.8 %, exact below that many vessels.
LG_ENTRIES = 14


def _count(sketch: Column) -> Column:
    """The number of vessels in a sketch; a missing set is empty."""
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0).cast("long"))


def daily_sets(pings: DataFrame, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """Per ``file_date``, its number of rows and the sketch of its vessels. Sketches are built on the map side."""
    return pings.groupBy("file_date").agg(F.count("*").alias("records"), F.theta_sketch_agg("MMSI", lg_entries).alias("vessels"))


def merge_sets(stored: DataFrame, new: DataFrame, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """The sets of both tables: rows that were added to a date join its stored set."""
    both = stored.unionByName(new)
    return both.groupBy("file_date").agg(F.sum("records").alias("records"), F.theta_union_agg("vessels", lg_entries).alias("vessels"))


def range_totals(sets: DataFrame, start: str, end: str, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """Days with rows, rows and distinct vessels from ``start`` to ``end``, both included; one row, zeros if there are none."""
    inside = sets.filter(F.col("file_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return inside.agg(
        F.count("*").alias("days"),
        F.coalesce(F.sum("records"), F.lit(0).cast("long")).alias("records"),
        _count(F.theta_union_agg("vessels", lg_entries)).alias("vessels"),
    )


def trailing_totals(sets: DataFrame, days: int = 7, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """Per stored date, rows and distinct vessels of the ``days`` calendar days that end with it."""
    ends = sets.select(F.col("file_date").alias("_end"))
    spread = sets.withColumn("_end", F.explode(F.sequence("file_date", F.date_add("file_date", days - 1))))
    return (
        spread.join(ends, "_end")
        .groupBy(F.col("_end").alias("file_date"))
        .agg(F.sum("records").alias("records"), _count(F.theta_union_agg("vessels", lg_entries)).alias("vessels"))
    )


def set_changes(sets: DataFrame) -> DataFrame:
    """Per stored date but the first, how many vessels are new, lost and common against the stored date before.

    The window runs over one row per date.
    """
    before = F.lag("vessels").over(Window.orderBy("file_date"))
    dated = sets.filter(F.col("file_date").isNotNull()).withColumn("_before", before).filter(F.col("_before").isNotNull())
    return dated.select(
        "file_date",
        _count(F.theta_difference("vessels", "_before")).alias("new_vessels"),
        _count(F.theta_difference("_before", "vessels")).alias("lost_vessels"),
        _count(F.theta_intersection("vessels", "_before")).alias("common_vessels"),
    )
