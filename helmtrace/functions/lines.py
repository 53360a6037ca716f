"""Array expressions on short point lists and parameter text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helmtrace.functions.geo import METERS_PER_DEGREE, col


def parse_int_list(text) -> Column:
    """Comma text to array<bigint>; blank items are skipped."""
    parts = F.transform(F.split(col(text), ","), lambda p: F.trim(p))
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: p.try_cast("bigint"))


def chaikin_smooth(points, iterations: int = 2) -> Column:
    """Corner cutting on array<struct<lat, lon>>: quarter points, then the last point."""
    line = col(points)

    def mix(a: Column, b: Column, share: float) -> Column:
        return F.struct(
            (a["lat"] * share + b["lat"] * (1 - share)).alias("lat"),
            (a["lon"] * share + b["lon"] * (1 - share)).alias("lon"),
        )

    for _ in range(iterations):
        n = F.size(line)
        cut = F.flatten(
            F.zip_with(
                F.slice(line, 1, F.greatest(n - 1, F.lit(0))),
                F.slice(line, 2, F.greatest(n - 1, F.lit(0))),
                lambda a, b: F.array(mix(a, b, 0.75), mix(a, b, 0.25)),
            )
        )
        line = F.when(n < 2, line).otherwise(F.concat(cut, F.slice(line, -1, 1)))
    return line


def pad_array(values, length, zero) -> Column:
    """Right-pad an array with ``zero`` to ``length``."""
    values = col(values)
    return F.concat(values, F.array_repeat(zero, F.greatest(col(length) - F.size(values), F.lit(0)).cast("int")))


def uncertainty_radius(distance_m, step, lat) -> Column:
    """Circle of a predicted point from the port–starboard distance."""
    distance_m, step, lat = col(distance_m), col(step), col(lat)
    raw = distance_m / 2 * (step / 8)
    per_degree = (F.cos(F.radians(lat)) * METERS_PER_DEGREE + METERS_PER_DEGREE) / 2
    diameter = raw * 20.0
    return F.struct(
        F.greatest(F.lit(100.0), F.least(raw, F.lit(50000.0))).alias("radius_m"),
        F.try_divide(raw, per_degree).alias("radius_deg"),
        F.when(step == 8, diameter).alias("diameter_m"),
        F.when(step == 8, diameter / 1852.0).alias("diameter_nm"),
    )
