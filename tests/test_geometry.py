import math
import random

import pytest
from pyspark.sql import functions as F

from helmtrace.functions import geo, lines, times
from helmtrace.operators import zones as Z
from tests.helpers import ping, table


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "angle, want", [(180.0, 180.0), (-180.0, -180.0), (181.0, -179.0), (-181.0, 179.0), (540.0, 180.0), (541.0, -179.0), (-511.0, -151.0)]
)
def test_wrap_180(spark, angle, want):
    assert value(spark, geo.wrap_180(F.lit(angle))) == want


def ring(spark, points, lat, lon):
    rows = spark.createDataFrame([([{"lat": a, "lon": b} for a, b in points], lat, lon)], "p array<struct<lat:double,lon:double>>, lat double, lon double")
    return rows.select(geo.in_polygon("lat", "lon", "p").alias("v")).first().v


SQUARE = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]


@pytest.mark.parametrize(
    "lat, lon, want",
    [(5, 5, True), (5, 10, True), (5, 10.1, False), (10, 5, True), (0, 5, False), (10, 0, True), (0, 0, False), (5, -1, False)],
)
def test_polygon_edges(spark, lat, lon, want):
    # Latitudes count in (min, max]; the western side is inside only through the edge rule.
    def plain(lat, lon, pts):
        inside = False
        for (a, b), (c, d) in zip(pts, pts[1:] + pts[:1]):
            if min(a, c) < lat <= max(a, c) and lon <= max(b, d) and (b == d or lon <= b + (lat - a) * (d - b) / (c - a)):
                inside = not inside
        return inside

    assert ring(spark, SQUARE, float(lat), float(lon)) == plain(lat, lon, SQUARE)
    if (lat, lon) in ((5, 5), (5, 10.1), (5, -1)):
        assert plain(lat, lon, SQUARE) == want


def test_polygon_of_two_points_is_empty(spark):
    assert ring(spark, SQUARE[:2], 0.0, 5.0) is False


def test_segment_distance_beyond_the_end(spark):
    beside = value(spark, geo.segment_distance_m(F.lit(0.01), F.lit(0.5), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    beyond = value(spark, geo.segment_distance_m(F.lit(0.0), F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    point = value(spark, geo.segment_distance_m(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    degree = math.radians(1) * 6371000
    assert beside == pytest.approx(degree / 100, rel=1e-6)
    assert beyond == pytest.approx(degree) and point == pytest.approx(degree)


def test_circle_boundary(spark):
    edge = math.radians(1) * 6371000
    inside = value(spark, geo.in_circle(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(edge + 1e-6)))
    outside = value(spark, geo.in_circle(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(edge - 1e-3)))
    assert inside and not outside


ZONES = [
    {"name": "dateline", "geometry_type": "circle", "center_lat": 10.0, "center_lon": 179.9, "radius_meters": 60000.0},
    {"name": "pole", "geometry_type": "circle", "center_lat": 89.5, "center_lon": 0.0, "radius_meters": 150000.0},
    {"name": "north", "geometry_type": "circle", "center_lat": 75.0, "center_lon": 40.0, "radius_meters": 900000.0},
    {"name": "line", "geometry_type": "polyline", "coordinates": "[[60,-30],[60,30]]", "tolerance_meters": 50000.0},
    {"name": "poly", "geometry_type": "polygon", "coordinates": "[[-5,-5],[12,3],[-4,9]]"},
    {"name": "world", "geometry_type": "odd"},
    {"name": "box", "lat_min": -3.0, "lat_max": 14.0, "lon_min": 170.0, "lon_max": 180.0},
    {"name": "off", "lat_min": -90.0, "lat_max": 90.0, "lon_min": -180.0, "lon_max": 180.0, "is_selected": False},
]


@pytest.mark.parametrize("control_bytes", [8 << 20, -1])
def test_zone_join_equals_all_pairs(spark, monkeypatch, control_bytes):
    """Both join shapes against a test of every ping with every zone."""
    monkeypatch.setattr(Z, "CONTROL_BYTES", control_bytes)
    rng = random.Random(5)
    around = [(10, 180), (10, -180), (89.5, 0), (89.9, 170), (60, 0), (64, 0), (0, 2), (75, 40), (5, 175)]
    spots = [(max(-90, min(90, a + rng.uniform(-6, 6))), (b + rng.uniform(-9, 9) + 180) % 360 - 180) for a, b in around * 40]
    rows = table(spark, [ping(i, "2024-01-01", lat=float(p[0]), lon=float(p[1])) for i, p in enumerate(spots)])
    zones = Z.zone_table(spark, ZONES)
    got = {(r.MMSI, r.ZoneName) for r in Z.pings_in_zones(rows, zones).collect()}
    every = rows.join(F.broadcast(zones)).filter(Z.in_zone("LAT", "LON")).select("MMSI", "name").collect()
    assert got == {(r.MMSI, r.name) for r in every}
    assert {n for _, n in got} == {z["name"] for z in ZONES} - {"off"}


def test_default_zones(spark):
    assert sorted(r.name for r in Z.zone_table(spark, [ZONES[-1]]).collect()) == ["South China Sea", "Strait of Hormuz"]


def test_chaikin_and_names(spark):
    line = F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(0.0).alias("lon")) for a in (0, 4, 8)])
    assert [p.lat for p in value(spark, lines.chaikin_smooth(line, 1))] == [1.0, 3.0, 5.0, 7.0, 8.0]
    one = F.slice(line, 1, 1)
    assert len(value(spark, lines.chaikin_smooth(one))) == 1
    for name, day in [("ais-2024-01-05.csv", "2024-01-05"), ("/a/2024-01-05.parquet", "2024-01-05"), ("AIS_2024_01_05.csv", "2024-01-05"), ("ais-2024-13-05.csv", None), ("x.csv", None)]:
        assert str(value(spark, times.date_from_name(F.lit(name)))) == str(day)
