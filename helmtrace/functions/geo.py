"""Distances, bearings and containment as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Earth radii in use.
RADIUS_NM = 3440.1
RADIUS_NM_TRACK = 3440.065
RADIUS_NM_SCORE = 3440.0
RADIUS_M = 6371000.0
METERS_PER_DEGREE = 111000.0


def col(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def haversine(lat1, lon1, lat2, lon2, radius: float = RADIUS_NM) -> Column:
    """Great-circle distance in the unit of ``radius``."""
    lat1, lon1, lat2, lon2 = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    half_lat = F.sin((lat2 - lat1) / 2)
    half_lon = F.sin((lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(lat1) * F.cos(lat2) * half_lon * half_lon
    return F.asin(F.sqrt(F.least(chord, F.lit(1.0)))) * (2.0 * radius)


def haversine_nm(lat1, lon1, lat2, lon2) -> Column:
    return haversine(lat1, lon1, lat2, lon2, RADIUS_NM)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    return haversine(lat1, lon1, lat2, lon2, RADIUS_M)


def bearing_radians(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    east = F.sin(lon2 - lon1) * F.cos(lat2)
    north = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(lon2 - lon1)
    return F.atan2(east, north)


def initial_bearing(lat1, lon1, lat2, lon2) -> Column:
    """Course from the first to the second position, in [0, 360)."""
    return F.pmod(F.degrees(bearing_radians(lat1, lon1, lat2, lon2)) + 360.0, F.lit(360.0))


def wrap_180(angle) -> Column:
    """Signed difference in [-180, 180]; both ends stay as they are."""
    d = col(angle)
    return (
        F.when(d > 180, d - F.ceil((d - 180) / 360) * 360)
        .when(d < -180, d + F.ceil((-d - 180) / 360) * 360)
        .otherwise(d)
    )


def offset_by_bearing(lat, lon, bearing, distance_nm) -> Column:
    """Flat-earth displacement: struct(lat, lon)."""
    lat, lon, bearing, distance_nm = (col(c) for c in (lat, lon, bearing, distance_nm))
    turn = F.radians(bearing)
    return F.struct(
        (lat + distance_nm / 60.0 * F.cos(turn)).alias("lat"),
        (lon + distance_nm / (F.cos(F.radians(lat)) * 60.0) * F.sin(turn)).alias("lon"),
    )


def in_rectangle(lat, lon, lat_min, lat_max, lon_min, lon_max) -> Column:
    return col(lat).between(col(lat_min), col(lat_max)) & col(lon).between(col(lon_min), col(lon_max))


def in_circle(lat, lon, center_lat, center_lon, radius_meters) -> Column:
    return haversine_m(lat, lon, center_lat, center_lon) <= col(radius_meters)


def parse_coordinates(text) -> Column:
    """JSON ``[[lat, lon], …]`` or ``[{"lat": …, "lon": …}, …]`` to an array of structs."""
    text = col(text)
    pairs = F.from_json(text, "array<array<double>>", {"mode": "PERMISSIVE"})
    pairs = F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("lat"), F.get(p, F.lit(1)).alias("lon")))
    objects = F.from_json(text, "array<struct<lat:double,lon:double>>")
    return F.when(text.rlike(r"^\s*\[\s*\{"), objects).otherwise(pairs)


def ring_edges(points) -> Column:
    """Edges of a closed ring as array<struct<a, b>>; the last edge returns to the start."""
    points = col(points)
    return F.zip_with(
        points,
        F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1)),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )


def line_edges(points) -> Column:
    points = col(points)
    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.zip_with(
        F.slice(points, 1, n), F.slice(points, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )


def in_polygon(lat, lon, points) -> Column:
    """Ray casting; an edge counts for latitudes in (min, max] of its ends."""
    lat, lon, points = col(lat), col(lon), col(points)

    def crosses(edge: Column) -> Column:
        a, b = edge["a"], edge["b"]
        at = a["lon"] + F.try_divide((lat - a["lat"]) * (b["lon"] - a["lon"]), b["lat"] - a["lat"])
        return (
            (lat > F.least(a["lat"], b["lat"]))
            & (lat <= F.greatest(a["lat"], b["lat"]))
            & (lon <= F.greatest(a["lon"], b["lon"]))
            & ((a["lon"] == b["lon"]) | (lon <= at))
        )

    crossings = F.size(F.filter(ring_edges(points), lambda e: F.coalesce(crosses(e), F.lit(False))))
    return (F.size(points) >= 3) & (crossings % 2 == 1)


def segment_distance_m(lat, lon, a_lat, a_lon, b_lat, b_lon) -> Column:
    """Metres to a segment: cross-track inside its length, nearest end outside."""
    lat, lon, a_lat, a_lon, b_lat, b_lon = (col(c) for c in (lat, lon, a_lat, a_lon, b_lat, b_lon))
    to_a = haversine_m(lat, lon, a_lat, a_lon)
    to_b = haversine_m(lat, lon, b_lat, b_lon)
    length = haversine_m(a_lat, a_lon, b_lat, b_lon)
    off_course = bearing_radians(a_lat, a_lon, lat, lon) - bearing_radians(a_lat, a_lon, b_lat, b_lon)
    arc = to_a / RADIUS_M
    across = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(arc) * F.sin(off_course))))
    ratio = F.try_divide(F.cos(arc), F.cos(across))
    along = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio))) * RADIUS_M
    return (
        F.when(length == 0, to_a)
        .when(along.between(F.lit(0.0), length), F.abs(across) * RADIUS_M)
        .otherwise(F.least(to_a, to_b))
    )


def near_polyline(lat, lon, points, tolerance_meters=100.0) -> Column:
    lat, lon, tolerance = col(lat), col(lon), col(tolerance_meters)
    return F.exists(
        line_edges(points),
        lambda e: segment_distance_m(lat, lon, e["a"]["lat"], e["a"]["lon"], e["b"]["lat"], e["b"]["lon"])
        <= tolerance,
    )
