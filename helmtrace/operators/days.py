"""Loaded days: their order, their neighbours, and the vessels of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmtrace.operators.spread import order_struct


def day_table(pings: DataFrame, keep: Column | None = None) -> DataFrame:
    """One row per listed date: position, whether rows survive ``keep``, and its neighbours.

    A date whose rows all fail ``keep`` still holds its place, so that the day after it has
    no previous day. The result has at most one row per calendar date.
    """
    flag = F.lit(True) if keep is None else keep
    per_date = pings.groupBy("file_date").agg(F.max(flag).alias("has_rows"))
    listed = per_date.agg(
        F.array_sort(F.collect_list(F.struct("file_date", "has_rows"))).alias("d")
    )
    first = F.array_position(F.transform("d", lambda x: x["has_rows"]), True)
    rows = listed.select("d", first.alias("first"), F.posexplode("d").alias("pos", "day"))
    before = F.get("d", F.col("pos") - 1)
    after = F.get("d", F.col("pos") + 1)
    return rows.select(
        F.col("day.file_date").alias("file_date"),
        (F.col("pos") + 1).alias("day_index"),
        F.col("day.has_rows").alias("has_rows"),
        (F.col("pos") + 1 == F.col("first")).alias("is_first"),
        before["file_date"].alias("prev_date"),
        F.coalesce(before["has_rows"], F.lit(False)).alias("prev_has_rows"),
        after["file_date"].alias("next_date"),
        F.coalesce(after["has_rows"], F.lit(False)).alias("next_has_rows"),
    )


def day_index(pings: DataFrame) -> DataFrame:
    return day_table(pings).select("file_date", "day_index")


def first_last_ping(pings: DataFrame) -> DataFrame:
    """Per vessel and date: number of pings, first and last ping as structs."""
    row = order_struct(pings, skip=["MMSI", "file_date"])
    return pings.groupBy("MMSI", "file_date").agg(
        F.count(F.lit(1)).alias("n"), F.min(row).alias("first"), F.max(row).alias("last")
    )


def vessel_days(pings: DataFrame, days: DataFrame) -> DataFrame:
    """``first_last_ping`` with the same vessel's previous and next loaded day beside it.

    The window runs over one row per vessel and date, never over pings.
    """
    # ``days`` has one row per calendar date, so its size is bounded.
    rows = first_last_ping(pings).join(F.broadcast(days), "file_date")
    walk = Window.partitionBy("MMSI").orderBy("day_index")
    return rows.withColumns(
        {
            "prev_index": F.lag("day_index").over(walk),
            "prev_last": F.lag("last").over(walk),
            "next_index": F.lead("day_index").over(walk),
        }
    )


def vessel_changes(pings: DataFrame, days: DataFrame) -> DataFrame:
    """Per date: vessels new since, lost since, and shared with the previous loaded day."""
    pairs = pings.select("MMSI", "file_date").distinct().join(F.broadcast(days), "file_date")
    walk = Window.partitionBy("MMSI").orderBy("day_index")
    pairs = pairs.withColumns({"p": F.lag("day_index").over(walk), "x": F.lead("day_index").over(walk)})
    seen_before = F.coalesce(F.col("p") == F.col("day_index") - 1, F.lit(False))
    seen_after = F.coalesce(F.col("x") == F.col("day_index") + 1, F.lit(False))
    change = F.struct(F.col("file_date").alias("Date"), F.when(seen_before, "common").otherwise("new").alias("Change"))
    here = F.when(F.col("prev_has_rows"), change)
    lost = F.when(
        F.col("next_has_rows") & ~seen_after,
        F.struct(F.col("next_date").alias("Date"), F.lit("lost").alias("Change")),
    )
    return pairs.select("MMSI", F.inline(F.array_compact(F.array(here, lost))))
