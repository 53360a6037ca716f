"""Course prediction for all vessels at once, its bounds, and its scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helmtrace.functions.angles import confidence_interval
from helmtrace.functions.geo import RADIUS_NM_SCORE, haversine, haversine_m, initial_bearing, offset_by_bearing
from helmtrace.functions.lines import uncertainty_radius
from helmtrace.operators.cleaning import recent_window
from helmtrace.operators.spread import exact_percentiles
from helmtrace.operators.tracks import latest_segment, with_measurements

STEPS = 8
STEP_HOURS = 6.0
# Points a step sees after the first one: the length of the model window.
CONTEXT_POINTS = 24

PREDICTION_SCHEMA = (
    "MMSI bigint, step int, lat double, lon double, std_lat double, std_lon double, speed double, course double"
)


def _recent_tracks(pings: DataFrame, hours: float) -> DataFrame:
    return with_measurements(latest_segment(recent_window(pings, hours)))


def last_known(pings: DataFrame, hours: float = 24.0) -> DataFrame:
    """Last ping of each vessel's latest usable track inside its recent window."""
    spot = F.max(F.struct("BaseDateTime", "LAT", "LON", "SOG", "COG", "Heading"))
    return _recent_tracks(pings, hours).groupBy("MMSI").agg(spot.alias("z")).select(
        "MMSI",
        F.col("z.BaseDateTime").alias("last_time"),
        F.col("z.LAT").alias("last_lat"),
        F.col("z.LON").alias("last_lon"),
        F.col("z.SOG").alias("last_sog"),
        F.coalesce("z.COG", "z.Heading").alias("last_course"),
    )


def predict_constant(pings: DataFrame, hours: float = 24.0, std_per_step: float = 0.05) -> DataFrame:
    """Eight 6-hour steps at the last speed and course, as built-in expressions.

    The deviation grows by ``std_per_step`` degrees a step. A vessel without a speed or
    course stays where it is.
    """
    start = F.struct(F.col("last_lat").alias("lat"), F.col("last_lon").alias("lon"))
    speed, course = F.coalesce("last_sog", F.lit(0.0)), F.coalesce("last_course", F.lit(0.0))

    def move(path: Column, _: Column) -> Column:
        here = F.element_at(path, -1)
        return F.concat(path, F.array(offset_by_bearing(here["lat"], here["lon"], course, speed * STEP_HOURS)))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.array(start), move)
    rows = last_known(pings, hours).withColumn("_path", F.slice(path, 2, STEPS))
    rows = rows.select("*", F.posexplode("_path").alias("_i", "_p"))
    std = (F.col("_i") + 1) * std_per_step
    return rows.select(
        "MMSI",
        (F.col("_i") + 1).alias("step"),
        F.col("_p.lat").alias("lat"),
        F.col("_p.lon").alias("lon"),
        std.alias("std_lat"),
        std.alias("std_lon"),
        speed.alias("speed"),
        course.alias("course"),
    )


def predict_tracks(
    pings: DataFrame, step: Callable[[np.ndarray], dict] | None = None, hours: float = 24.0, steps: int = STEPS
) -> DataFrame:
    """Autoregressive prediction per vessel with a caller's step function.

    ``step`` gets a ``(points, 5)`` array of LAT, LON, SOG, COG, Heading and returns ``mean``
    and ``std`` (lat, lon) and may return ``speed`` and ``course``. The first step sees the whole recent track;
    from then on it sees the last 24 points, new ones included. Vessels lie side by side in a sorted partition
    and arrive in batches, so a task holds five numbers per ping of one vessel's recent hours and no more.
    Without ``step`` the constant-velocity prediction runs, which needs no Python.
    """
    if step is None:
        return predict_constant(pings, hours)
    fields = ["LAT", "LON", "SOG", "COG", "Heading"]
    context = _recent_tracks(pings, hours).select("MMSI", "BaseDateTime", *fields)
    context = context.repartition("MMSI").sortWithinPartitions("MMSI", "BaseDateTime", *[F.desc(c) for c in fields])
    names = [c.split()[0] for c in PREDICTION_SCHEMA.split(", ")]

    def walk(mmsi: int, points: np.ndarray) -> list[tuple]:
        rows = []
        for n in range(1, steps + 1):
            out = step(points)
            lat, lon = out["mean"]
            std_lat, std_lon = out["std"]
            speed, course = out.get("speed"), out.get("course")
            rows.append((mmsi, n, lat, lon, std_lat, std_lon, speed, course))
            extra = [v for v in (speed, course) if v is not None]
            fresh = np.array([lat, lon, *extra] + [0.0] * (len(fields) - 2 - len(extra)))
            points = np.vstack([points, fresh])[-CONTEXT_POINTS:]
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for batch in batches:
            rows = []
            ids = batch["MMSI"].to_numpy()
            cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1 if len(ids) else []
            values = batch[fields].to_numpy(dtype=float)
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)]):
                if lo == hi:
                    continue
                if ids[lo] != now:
                    rows += walk(int(now), np.concatenate(held)) if held else []
                    now, held = ids[lo], []
                held.append(values[lo:hi])
            yield pd.DataFrame(rows, columns=names)
        yield pd.DataFrame(walk(int(now), np.concatenate(held)) if held else [], columns=names)

    return context.mapInPandas(run, PREDICTION_SCHEMA)


def prediction_intervals(predictions: DataFrame, confidence: float = 0.68) -> DataFrame:
    lat = confidence_interval("lat", "std_lat", confidence)
    lon = confidence_interval("lon", "std_lon", confidence)
    return predictions.select(
        "*",
        lat["lower"].alias("lower_lat"),
        lat["upper"].alias("upper_lat"),
        lon["lower"].alias("lower_lon"),
        lon["upper"].alias("upper_lon"),
    )


def sample_positions(predictions: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """``n`` normal draws around each predicted position."""
    rows = predictions.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return rows.select(
        "MMSI",
        "step",
        "sample",
        (F.col("lat") + F.col("std_lat") * F.randn(seed)).alias("lat"),
        (F.col("lon") + F.col("std_lon") * F.randn(seed + 1)).alias("lon"),
    )


def prediction_cone(predictions: DataFrame, known: DataFrame) -> DataFrame:
    """Port and starboard bound of every step.

    Each bound walks on from its own previous point, so the steps of a vessel (eight rows)
    are folded in one array expression.
    """
    entry = F.struct("step", "lat", "lon", "std_lat", "std_lon", "speed", "course")
    paths = predictions.groupBy("MMSI").agg(F.array_sort(F.collect_list(entry)).alias("p")).join(known, "MMSI")
    start = F.struct(F.col("last_lat").alias("lat"), F.col("last_lon").alias("lon"))
    before = F.concat(F.array(start), F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))))

    def plan(x: Column, i: Column) -> Column:
        prev = F.get(before, i)
        bearing = initial_bearing(prev["lat"], prev["lon"], x["lat"], x["lon"])
        course = F.coalesce(x["course"], F.when(i == 0, F.coalesce(F.col("last_course"), bearing)).otherwise(bearing))
        share = x["step"] / 8.0
        spread = F.coalesce((x["std_lat"] + x["std_lon"]) / 2 * 0.5, F.lit(2.0)) * share
        distance = F.coalesce(x["speed"], F.col("last_sog"), F.lit(10.0)) * STEP_HOURS
        return F.struct(
            x["step"].alias("step"),
            x["lat"].alias("lat"),
            x["lon"].alias("lon"),
            course.alias("course"),
            F.least(spread, F.lit(45.0)).alias("spread"),
            F.least(distance, F.lit(500.0)).alias("distance"),
        )

    def walk(side: int) -> Column:
        def go(path: Column, x: Column) -> Column:
            here = F.element_at(path, -1)
            there = offset_by_bearing(
                here["lat"], here["lon"], F.pmod(x["course"] + x["spread"] * side, F.lit(360.0)), x["distance"]
            )
            valid = there["lat"].between(-90, 90) & there["lon"].between(-180, 180)
            fallback = F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))
            return F.concat(path, F.array(F.when(valid, there).otherwise(fallback)))

        return F.slice(F.aggregate("steps", F.array(start), go), 2, STEPS)

    rows = paths.withColumn("steps", F.transform("p", plan))
    rows = rows.select("MMSI", "steps", walk(-1).alias("port"), walk(1).alias("starboard"))
    out = rows.select("MMSI", F.inline(F.arrays_zip("steps", "port", "starboard")))
    return out.select(
        "MMSI",
        "steps.step",
        "steps.lat",
        "steps.lon",
        "steps.course",
        F.col("steps.spread").alias("angular_offset"),
        F.col("steps.distance").alias("distance_nm"),
        F.col("port.lat").alias("port_lat"),
        F.col("port.lon").alias("port_lon"),
        F.col("starboard.lat").alias("starboard_lat"),
        F.col("starboard.lon").alias("starboard_lon"),
    )


def cone_circles(cone: DataFrame) -> DataFrame:
    """Uncertainty circle per step; coinciding bounds are drawn one mile from the point instead."""
    port = offset_by_bearing("lat", "lon", F.pmod(F.col("course") - F.col("angular_offset"), F.lit(360.0)), 1.0)
    star = offset_by_bearing("lat", "lon", F.pmod(F.col("course") + F.col("angular_offset"), F.lit(360.0)), 1.0)
    apart = haversine_m("port_lat", "port_lon", "starboard_lat", "starboard_lon")
    drawn = haversine_m(port["lat"], port["lon"], star["lat"], star["lon"])
    circle = uncertainty_radius(F.when(apart >= 1.0, apart).otherwise(drawn), "step", "lat")
    return cone.select("MMSI", "step", "lat", "lon", circle.alias("c")).select("MMSI", "step", "lat", "lon", "c.*")


# --- scores -------------------------------------------------------------------------------


def prediction_metrics(scored: DataFrame) -> DataFrame:
    """Error and calibration figures over rows of predicted and target positions.

    Needs ``lat lon std_lat std_lon target_lat target_lon``.
    """
    error = haversine("lat", "lon", "target_lat", "target_lon", RADIUS_NM_SCORE)
    sigma = (F.col("std_lat") + F.col("std_lon")) / 2 * 60.0
    rows = scored.withColumns({"_e": error, "_s": sigma})
    sums = rows.agg(
        F.avg("_e").alias("mae_nm"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse_nm"),
        F.avg((F.col("_e") <= F.col("_s")).cast("int")).alias("coverage_1sigma"),
        F.avg((F.col("_e") <= F.col("_s") * 2).cast("int")).alias("coverage_2sigma"),
        F.avg(F.abs(F.col("lat") - F.col("target_lat"))).alias("mae_lat_deg"),
        F.avg(F.abs(F.col("lon") - F.col("target_lon"))).alias("mae_lon_deg"),
        F.avg("std_lat").alias("mean_uncertainty_lat_deg"),
        F.avg("std_lon").alias("mean_uncertainty_lon_deg"),
        F.avg("_s").alias("mean_uncertainty_nm"),
    )
    ranks = exact_percentiles(
        rows, [], "_e", {"median_error_nm": 0.5, "p90_error_nm": 0.9, "p95_error_nm": 0.95}
    )
    return sums.withColumn("k", F.lit(1)).join(ranks.withColumn("k", F.lit(1)), "k").drop("k")


# Weights of the loss parts.
LOSS_WEIGHTS = {"position": 1.0, "speed": 0.5, "course": 0.5, "uncertainty": 0.3, "physics": 0.2}


def prediction_losses(
    scored: DataFrame,
    max_speed: float = 50.0,
    max_turn_rate: float = 180.0,
    cog_in_radians: bool = False,
) -> DataFrame:
    """Position, speed, course, likelihood and physics losses and their weighted total.

    Needs the columns of ``prediction_metrics`` and ``speed course target_sog target_cog last_course``.
    """

    def square(a: str, b: str) -> Column:
        return (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))

    def likelihood(side: str) -> Column:
        sigma = F.greatest(F.col(f"std_{side}"), F.lit(1e-6))
        gap = F.col(f"target_{side}") - F.col(side)
        return F.log(sigma * sigma * (2 * np.pi)) * 0.5 + gap * gap / (sigma * sigma) * 0.5

    heading = F.degrees("last_course") if cog_in_radians else F.col("last_course")
    turn = F.abs(F.col("course") - heading)
    turn_rate = F.least(turn, F.lit(360.0) - turn) / 48.0
    parts = scored.agg(
        ((F.avg(square("lat", "target_lat")) + F.avg(square("lon", "target_lon"))) / 2).alias("position"),
        F.avg(square("speed", "target_sog")).alias("speed"),
        F.avg(F.lit(1.0) - F.cos(F.radians(F.col("course") - F.col("target_cog")))).alias("course"),
        F.avg(likelihood("lat") + likelihood("lon")).alias("uncertainty"),
        (
            (
                F.avg(F.greatest(F.col("speed") - max_speed, F.lit(0.0)))
                + F.avg(F.greatest(turn_rate - max_turn_rate, F.lit(0.0)))
            )
            / 2
        ).alias("physics"),
    )
    total = sum((F.col(k) * w for k, w in LOSS_WEIGHTS.items()), F.lit(0.0))
    return parts.withColumn("total", total).withColumnsRenamed({k: f"{k}_loss" for k in [*LOSS_WEIGHTS, "total"]})
