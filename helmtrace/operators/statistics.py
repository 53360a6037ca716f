"""Run statistics: totals, nulls by column, vessel and day; bounds and centres."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_statistics(pings: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    # The distinct counts run over one row per vessel and date, not over pings.
    return pings.groupBy("file_date", "MMSI").agg(F.count(F.lit(1)).alias("n")).agg(
        F.countDistinct("file_date").alias("days_analyzed"),
        F.sum("n").alias("records_analyzed"),
        distinct("MMSI").alias("unique_mmsi"),
    )


def _nulls(columns: Sequence[str]) -> list:
    return [F.count_if(F.col(c).isNull()).alias(c) for c in columns]


def nulls_by_column(table: DataFrame) -> DataFrame:
    """Long form: one row per column."""
    return table.agg(*_nulls(table.columns)).unpivot([], table.columns, "Column", "Total_Null_Values")


def nulls_by_vessel(pings: DataFrame) -> DataFrame:
    return pings.groupBy("MMSI").agg(*_nulls([c for c in pings.columns if c != "MMSI"]))


def nulls_by_vessel_day(pings: DataFrame) -> DataFrame:
    rest = [c for c in pings.columns if c not in ("MMSI", "file_date")]
    return pings.groupBy("file_date", "MMSI").agg(*_nulls(rest))


def bounds(table: DataFrame, padding: float = 5.0) -> DataFrame:
    box = table.agg(
        (F.min("LAT") - padding).alias("min_lat"),
        (F.max("LAT") + padding).alias("max_lat"),
        (F.min("LON") - padding).alias("min_lon"),
        (F.max("LON") + padding).alias("max_lon"),
    )
    return box.withColumns(
        {
            "center_lat": (F.col("min_lat") + F.col("max_lat")) / 2,
            "center_lon": (F.col("min_lon") + F.col("max_lon")) / 2,
        }
    )


def centroid(table: DataFrame) -> DataFrame:
    return table.agg(F.avg("LAT").alias("lat"), F.avg("LON").alias("lon"))
