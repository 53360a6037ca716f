"""Zones: table, bounds, containment and the join with pings."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from helmtrace.functions.geo import (
    METERS_PER_DEGREE,
    RADIUS_M,
    haversine_m,
    in_circle,
    in_polygon,
    in_rectangle,
    line_edges,
    near_polyline,
    parse_coordinates,
)
from helmtrace.schemas import DEFAULT_ZONES, ZONE_SCHEMA

CELL_DEGREES = 5.0
CONTROL_BYTES = 8 << 20


def zone_table(spark: SparkSession, zones: Sequence[dict] | DataFrame | None = None) -> DataFrame:
    """Selected zones with parsed coordinates; the two default rectangles if none is selected."""
    if isinstance(zones, DataFrame):
        table = zones.select(
            *[
                (F.col(f.name) if f.name in zones.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in ZONE_SCHEMA.fields
            ]
        )
    else:
        chosen = [z for z in zones or [] if z.get("is_selected", True)] or DEFAULT_ZONES
        layout = to_arrow_schema(ZONE_SCHEMA)
        rows = [{n: z.get(n) for n in ZONE_SCHEMA.fieldNames()} for z in chosen]
        # An Arrow table becomes a local relation, whose projections the optimizer evaluates.
        table = spark.createDataFrame(pa.Table.from_pylist(rows, layout), ZONE_SCHEMA)
    table = table.filter(F.coalesce("is_selected", F.lit(True)))
    return table.select(
        F.coalesce("name", F.lit("Unknown Zone")).alias("name"),
        F.coalesce("geometry_type", F.lit("rectangle")).alias("geometry_type"),
        "lat_min",
        "lat_max",
        "lon_min",
        "lon_max",
        "center_lat",
        "center_lon",
        "radius_meters",
        F.coalesce(parse_coordinates("coordinates"), F.array().cast("array<struct<lat:double,lon:double>>")).alias(
            "points"
        ),
        F.coalesce("tolerance_meters", F.lit(100.0)).alias("tolerance_meters"),
    )


def _points(pick, side) -> Column:
    return pick(F.transform("points", lambda p: p[side]))


def zone_bounds(zones: DataFrame) -> DataFrame:
    """Bounding box as reported with a violation (one degree counted as 111 km)."""
    high = F.col("radius_meters") / METERS_PER_DEGREE
    wide = F.try_divide(
        F.col("radius_meters"), F.abs(F.cos(F.radians("center_lat"))) * METERS_PER_DEGREE
    )
    kind = F.col("geometry_type")
    shape = kind.isin("polygon", "polyline")
    world = {"lat_min": -90.0, "lat_max": 90.0, "lon_min": -180.0, "lon_max": 180.0}

    def bound(name: str) -> Column:
        side, pick = name.split("_")[0], (F.array_min if name.endswith("min") else F.array_max)
        sign = -1 if name.endswith("min") else 1
        spread = high if side == "lat" else wide
        return (
            F.when(kind == "circle", F.col(f"center_{side}") + spread * sign)
            .when(shape & (F.size("points") > 0), _points(pick, side))
            .when(shape, F.lit(world[name]))
            .otherwise(F.coalesce(name, F.lit(world[name])))
        )

    return zones.withColumns(
        {f"Zone{s}{e}": bound(f"{s.lower()}_{e.lower()}") for s in ("Lat", "Lon") for e in ("Min", "Max")}
    )


def in_zone(lat: str, lon: str) -> Column:
    """Exact test of a position against the zone columns beside it."""
    kind = F.col("geometry_type")
    return F.coalesce(
        F.when(kind == "circle", in_circle(lat, lon, "center_lat", "center_lon", "radius_meters"))
        .when(kind == "polygon", in_polygon(lat, lon, "points"))
        .when(kind == "polyline", near_polyline(lat, lon, "points", "tolerance_meters"))
        .otherwise(
            in_rectangle(
                lat,
                lon,
                F.coalesce("lat_min", F.lit(-90.0)),
                F.coalesce("lat_max", F.lit(90.0)),
                F.coalesce("lon_min", F.lit(-180.0)),
                F.coalesce("lon_max", F.lit(180.0)),
            )
        ),
        F.lit(False),
    )


def _search_box(zones: DataFrame) -> DataFrame:
    """A box no position of the zone can lie outside of; used to choose grid cells.

    Circles and polylines are covered by discs (a polyline by one disc per vertex, wide
    enough for half its longest edge). A disc that reaches a pole or the date line takes
    every longitude.
    """
    kind = F.col("geometry_type")
    longest = F.coalesce(
        F.array_max(
            F.transform(
                line_edges("points"), lambda e: haversine_m(e["a"]["lat"], e["a"]["lon"], e["b"]["lat"], e["b"]["lon"])
            )
        ),
        F.lit(0.0),
    )
    disc = F.when(kind == "circle", F.col("radius_meters")).when(
        kind == "polyline", F.col("tolerance_meters") + longest / 2
    )
    arc = F.coalesce(disc / RADIUS_M * 1.001, F.lit(0.0))
    lats = F.when(kind == "circle", F.array("center_lat")).otherwise(F.transform("points", lambda p: p["lat"]))
    lons = F.when(kind == "circle", F.array("center_lon")).otherwise(F.transform("points", lambda p: p["lon"]))
    top = F.array_max(F.transform(lats, lambda v: F.abs(v)))
    spread = F.when(
        F.radians(top) + arc < 1.57,
        F.degrees(F.asin(F.least(F.lit(1.0), F.sin(arc) / F.greatest(F.cos(F.radians(top)), F.lit(1e-9))))),
    ).otherwise(F.lit(360.0))
    z = zones.withColumns({"_arc": arc, "_lats": lats, "_lons": lons, "_spread": spread})
    shaped = kind.isin("circle", "polygon", "polyline")
    low_lon = F.array_min("_lons") - F.col("_spread")
    high_lon = F.array_max("_lons") + F.col("_spread")
    wraps = kind.isin("circle", "polyline") & ((low_lon < -180) | (high_lon > 180) | (high_lon - low_lon > 180))
    return z.withColumns(
        {
            "_s": F.when(shaped, F.array_min("_lats") - F.degrees("_arc")).otherwise(F.coalesce("lat_min", F.lit(-90.0))),
            "_n": F.when(shaped, F.array_max("_lats") + F.degrees("_arc")).otherwise(F.coalesce("lat_max", F.lit(90.0))),
            "_w": F.when(wraps, F.lit(-180.0))
            .when(shaped, low_lon)
            .otherwise(F.coalesce("lon_min", F.lit(-180.0))),
            "_e": F.when(wraps, F.lit(180.0))
            .when(shaped, high_lon)
            .otherwise(F.coalesce("lon_max", F.lit(180.0))),
        }
    ).drop("_arc", "_lats", "_lons", "_spread")


def _cell(value: Column, low: float, high: float) -> Column:
    bounded = F.greatest(F.lit(low), F.least(F.lit(high), value))
    return F.floor((bounded - low) / CELL_DEGREES).cast("int")


def _bytes_of(zones: DataFrame, cells: DataFrame) -> int:
    """An upper estimate of what the zones and their cells take in memory."""
    size = F.lit(400) + F.length("name") * 4 + F.size("points") * 32
    return int(zones.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]) + 100 * cells.count()


def pings_in_zones(pings: DataFrame, zones: DataFrame) -> DataFrame:
    """Pings paired with the zones they lie in.

    Zones are spread over 5-degree cells, of which a row holds only the zone's number and search box (at most
    2,664 rows per zone). Pings join on the cell and pass the box test; only pairs that pass get the
    zone's geometry, which exists once per zone, for the exact test. Both small tables are broadcast if their measured
    size is at most ``CONTROL_BYTES``; beyond it both joins shuffle, and adaptive execution splits busy cells and zones.
    """
    boxed = _search_box(zone_bounds(zones)).filter(
        (F.col("_s") <= F.col("_n")) & (F.col("_w") <= F.col("_e"))
    )
    # A zone's number is its content: repeats of a zone stay repeats through the counts below.
    numbered = boxed.withColumn("_zone", F.xxhash64(*boxed.columns)).withColumn(
        "_copy", F.row_number().over(Window.partitionBy("_zone").orderBy("name"))
    )
    cells = (
        numbered.select("_zone", "_copy", "_s", "_n", "_w", "_e")
        .withColumn("_clat", F.explode(F.sequence(_cell(F.col("_s"), -90.0, 90.0), _cell(F.col("_n"), -90.0, 90.0))))
        .withColumn("_clon", F.explode(F.sequence(_cell(F.col("_w"), -180.0, 180.0), _cell(F.col("_e"), -180.0, 180.0))))
    )
    shapes = numbered.drop("_s", "_n", "_w", "_e")
    if _bytes_of(numbered, cells) <= CONTROL_BYTES:
        cells, shapes = F.broadcast(cells), F.broadcast(shapes)
    placed = pings.withColumns(
        {"_clat": _cell(F.col("LAT"), -90.0, 90.0), "_clon": _cell(F.col("LON"), -180.0, 180.0)}
    )
    boxed_test = F.col("LAT").between(F.col("_s"), F.col("_n")) & F.col("LON").between(F.col("_w"), F.col("_e"))
    near = placed.join(cells, ["_clat", "_clon"]).filter(boxed_test).select(*pings.columns, "_zone", "_copy")
    return near.join(shapes, ["_zone", "_copy"]).filter(in_zone("LAT", "LON")).select(
        *pings.columns,
        F.col("name").alias("ZoneName"),
        "ZoneLatMin",
        "ZoneLatMax",
        "ZoneLonMin",
        "ZoneLonMax",
    )
