"""Data behind the map layers: heat points, paths, anomaly pins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helmtrace.operators.cleaning import vessel_type_name
from helmtrace.operators.spread import add_position, bracket, nearest_of
from helmtrace.operators.vessels import vessel_info_lookup

FILLED = ["VesselName", "VesselType", "SOG", "COG", "Heading"]


def heat_points(table: DataFrame, *by: str) -> DataFrame:
    """One weighted point per row, with the layer columns ``by`` (type, date) beside it."""
    rows = table.filter(F.col("LAT").isNotNull() & F.col("LON").isNotNull())
    return rows.select(*by, "LAT", "LON", F.lit(1.0).alias("weight"))


def heat_grid(table: DataFrame, *by: str, digits: int = 2) -> DataFrame:
    """The same weights summed per rounded position, for tables too large to draw point by point."""
    cell = {"LAT": F.round("LAT", digits), "LON": F.round("LON", digits)}
    return heat_points(table, *by).withColumns(cell).groupBy(*by, "LAT", "LON").agg(F.sum("weight").alias("weight"))


def path_points(pings: DataFrame, per_day: bool = False) -> DataFrame:
    """Positions of each vessel (and day) numbered in time order.

    The long form replaces one list per vessel: a path of any length stays spread over tasks. Rows without a
    time or position have no place in a path.
    """
    keys = ["MMSI", "file_date"] if per_day else ["MMSI"]
    rows = pings.filter(F.col("LAT").isNotNull() & F.col("LON").isNotNull() & F.col("BaseDateTime").isNotNull())
    return add_position(rows.select(*keys, "BaseDateTime", "LAT", "LON"), keys)


def vessel_paths(pings: DataFrame, per_day: bool = False) -> DataFrame:
    """One row per path: points, ends, and the first name and type."""
    keys = ["MMSI", "file_date"] if per_day else ["MMSI"]
    rows = pings.filter(F.col("LAT").isNotNull() & F.col("LON").isNotNull())
    spot = F.struct("BaseDateTime", "LAT", "LON", "VesselName", "VesselType")
    ends = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.min(spot).alias("a"), F.max(spot).alias("z"))
    return ends.select(
        *keys,
        "points",
        F.col("a.VesselName").alias("VesselName"),
        F.col("a.VesselType").alias("VesselType"),
        F.col("a.BaseDateTime").alias("start"),
        F.col("a.LAT").alias("start_lat"),
        F.col("a.LON").alias("start_lon"),
        F.col("z.BaseDateTime").alias("end"),
        F.col("z.LAT").alias("end_lat"),
        F.col("z.LON").alias("end_lon"),
    )


def nearest_ping(anomalies: DataFrame, pings: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Adds ``match``: the same vessel's ping closest in time, the earlier one on a tie.

    An anomaly without a time gets the vessel's first ping.
    """
    fields = fields or ["LAT", "LON", *FILLED]
    found = bracket(anomalies, pings, ["MMSI"], "BaseDateTime", fields)
    return found.withColumn("match", nearest_of("BaseDateTime")).drop("before", "after")


def anomaly_pins(anomalies: DataFrame, pings: DataFrame) -> DataFrame:
    """Popup values per anomaly: its own, else the nearest ping's, else the vessel's usual ones."""
    placed = anomalies.filter(F.col("LAT").isNotNull() & F.col("LON").isNotNull())
    vessels = anomalies.select("MMSI").distinct()
    own = pings.join(vessels, "MMSI", "left_semi")
    rows = nearest_ping(placed, own).join(vessel_info_lookup(own), "MMSI", "left")

    def fill(column: str, *more):
        return F.coalesce(F.nullif(F.col(column), F.lit("")) if column == "VesselName" else F.col(column), F.col("match")[column], *more)

    kind = fill("VesselType", F.col("InfoType"))
    return rows.select(
        "MMSI",
        "LAT",
        "LON",
        "BaseDateTime",
        "AnomalyType",
        fill("VesselName", F.col("InfoName"), F.lit("Unknown")).alias("VesselName"),
        F.when(
            kind.isNotNull(), F.concat(kind.cast("string"), F.lit(" ("), vessel_type_name(kind), F.lit(")"))
        ).otherwise("Unknown").alias("VesselType"),
        fill("SOG").alias("SOG"),
        fill("COG").alias("COG"),
        fill("Heading").alias("Heading"),
    )
