"""Sliding training sequences, their batches, splits and quality reports.

A sequence is a row of the sequence table (its key, length and target) and, in long form, its points: one row
per point with a ``position``. No array and no task grows with the number of points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmtrace.functions.times import HOUR_US, chunk_of, hours_between, micros
from helmtrace.operators.anomalies import count_by
from helmtrace.operators.cleaning import category_of
from helmtrace.operators.spread import add_position, bracket, exact_percentiles, global_rank, nearest_of
from helmtrace.operators.tracks import MEASUREMENTS, TRACK, segment_tracks
from helmtrace.operators.vessels import first_value
from helmtrace.session import stage

WINDOW = [*TRACK, "window_no"]
SLIDE_HOURS = 6
FEATURES = {"lat": "LAT", "lon": "LON", "sog": "SOG", "cog": "COG", "heading": "Heading"}


def _trajectories(pings: DataFrame) -> DataFrame:
    """Usable tracks without implausible speeds; rows without a speed stay."""
    rows = segment_tracks(pings)
    if "SOG" not in rows.columns:
        return rows
    return rows.filter(F.col("SOG").isNull() | F.isnan("SOG") | (F.col("SOG") <= 100.0))


def _track_plan(trajectories: DataFrame, hours: int, slide: int) -> DataFrame:
    """Per track and time chunk: the track's first time, span and number of windows.

    The window runs over chunk rows, one per vessel and hour, never over pings.
    """
    chunks = (
        trajectories.groupBy(*TRACK, chunk_of("BaseDateTime").alias("time_chunk"))
        .agg(F.min(micros("BaseDateTime")).alias("_a"), F.max(micros("BaseDateTime")).alias("_z"))
    )
    track = Window.partitionBy(*TRACK)
    spans = chunks.withColumns({"t0": F.min("_a").over(track), "t1": F.max("_z").over(track)}).drop("_a", "_z")
    span = (F.col("t1") - F.col("t0")) / F.lit(float(HOUR_US))
    return spans.withColumns(
        {
            "span_hours": span,
            "slide_hours": F.lit(slide),
            "windows": F.when(span < hours, F.lit(1).cast("long")).otherwise(F.floor((span - hours) / slide) + 1),
        }
    )


def window_starts(trajectories: DataFrame, hours: int = 24, slide: int = SLIDE_HOURS) -> DataFrame:
    """Per track: first time, span, slide hours and number of windows.

    Tracks shorter than a window get one window over everything.
    """
    return _track_plan(trajectories, hours, slide).drop("time_chunk").distinct()


def window_points(trajectories: DataFrame, hours: int = 24, slide: int = SLIDE_HOURS) -> DataFrame:
    """Pings with the number of each window they fall in.

    The windows are regular, so a ping's window numbers follow from its time: no range join. What a ping
    has to know of its track comes by track and time chunk, so no join key holds more than an hour of a vessel.
    """
    plan = _track_plan(trajectories, hours, slide)
    rows = trajectories.withColumn("time_chunk", chunk_of("BaseDateTime")).join(plan, [*TRACK, "time_chunk"])
    since = micros("BaseDateTime") - F.col("t0")
    step, width = slide * HOUR_US, F.lit(hours * HOUR_US)
    low = F.greatest(F.lit(0), F.floor((since - width) / step) + 1)
    high = F.least(F.floor(since / step), F.col("windows") - 1)
    numbers = F.when(F.col("span_hours") < hours, F.array(F.lit(0).cast("long"))).when(low <= high, F.sequence(low, high))
    return rows.withColumn("window_no", F.explode(numbers)).drop("time_chunk", "t0", "t1", "span_hours", "slide_hours", "windows")


def sequence_target(ends: DataFrame, trajectories: DataFrame, horizon_hours: float = 48.0) -> DataFrame:
    """For each window end, the later ping nearest to ``end + horizon``.

    ``ends`` has the window key and ``last_known_time``; windows without a later ping drop out. Speed and
    course of the target are null where the pings have no such column.
    """
    asks = ends.withColumn(
        "_ideal", F.timestamp_micros(micros("last_known_time") + F.lit(int(horizon_hours * HOUR_US)))
    )
    measured = [c for c in ("SOG", "COG") if c in trajectories.columns]
    found = bracket(asks, trajectories, TRACK, "_ideal", ["LAT", "LON", *measured])
    # The ping at or before the ideal time counts only if it lies after the window.
    early = F.when(F.col("before")["ts"] > F.col("last_known_time"), F.col("before"))
    found = found.withColumn("before", early).withColumn("_t", nearest_of("_ideal"))
    return found.filter(F.col("_t").isNotNull()).select(
        *ends.columns,
        F.col("_t.LAT").alias("target_lat"),
        F.col("_t.LON").alias("target_lon"),
        *[
            (F.col(f"_t.{c}") if c in measured else F.lit(None).cast("double")).alias(f"target_{c.lower()}")
            for c in ("SOG", "COG")
        ],
        F.col("_t.ts").alias("prediction_time"),
    )


def training_sequences(
    pings: DataFrame,
    hours: int = 24,
    horizon_hours: float = 48.0,
    slide: int = SLIDE_HOURS,
    work_dir: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The sequences (key, length, last known time, target) and their points in long form.

    A sequence has at least two points and a later ping to aim at; nothing else limits it. Points have the
    key, ``position`` from 0, ``ts``, ``lat``, ``lon`` and those of ``sog``, ``cog`` and ``heading`` that
    the pings have. Tracks, window ends and targets are each needed several times, so they are stored in
    ``work_dir`` (or below ``spark.checkpoint.dir``) as they are made.
    """
    rows = stage(_trajectories(pings), "tracks", work_dir)
    placed = window_points(rows, hours, slide)
    ends = (
        placed.groupBy(*WINDOW)
        .agg(F.count(F.lit(1)).alias("length"), F.max("BaseDateTime").alias("last_known_time"))
        .filter(F.col("length") >= 2)
    )
    ends = stage(ends, "ends", work_dir)
    targets = stage(sequence_target(ends, rows, horizon_hours), "targets", work_dir)
    kept = [c for c in FEATURES if FEATURES[c] in rows.columns]
    points = add_position(
        placed.join(targets.select(*WINDOW), WINDOW, "left_semi").select(
            *WINDOW, "BaseDateTime", *[FEATURES[c] for c in kept]
        ),
        WINDOW,
        "position",
        order=("LAT", "LON", *[c for c in MEASUREMENTS if c in rows.columns]),
    )
    return targets, points.select(
        *WINDOW, "position", F.col("BaseDateTime").alias("ts"), *[F.col(FEATURES[c]).alias(c) for c in kept]
    )


def sequence_matrix(points: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The points with ``features`` (one matrix row each) and their column names."""
    columns = list(columns or [c for c in FEATURES if c in points.columns])
    return points.select(
        *WINDOW,
        "position",
        F.array(*[F.col(c).cast("double") for c in columns]).alias("features"),
        F.array(*[F.lit(c) for c in columns]).alias("feature_columns"),
    )


def _is_typed(column: str = "VesselType") -> Column:
    return F.col(column).between(20, 99)


def typed_vessel_semijoin(sequences: DataFrame, pings: DataFrame) -> DataFrame:
    return sequences.join(pings.filter(_is_typed()).select("MMSI").distinct(), "MMSI", "left_semi")


def sequences_by_category(sequences: DataFrame, pings: DataFrame) -> DataFrame:
    """Number of sequences per category of the vessel's first type."""
    per_vessel = count_by(sequences, "MMSI", name="_n")
    kinds = first_value(pings, ["MMSI"], "VesselType")
    joined = per_vessel.join(kinds, "MMSI", "left").withColumn(
        "Category", F.coalesce(category_of("VesselType"), F.lit("Unknown"))
    )
    return joined.groupBy("Category").agg(F.sum("_n").alias("Sequences"))


# --- batches and splits -------------------------------------------------------------------

# Upper ends of the length bins.
LENGTH_BINS = [8, 20, 50, 100, 200]


def length_bin(length: str = "length") -> Column:
    out = None
    for i, top in enumerate(LENGTH_BINS):
        test = F.col(length) <= top
        out = F.when(test, i) if out is None else out.when(test, i)
    return out.otherwise(len(LENGTH_BINS))


def _mixed(seed: int, keys: Sequence[str]) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def _range_of(rows: DataFrame, key: str, ranges: int = 256) -> Column:
    """The number of the measured value range of ``key`` that a row lies in; a range holds about as many rows
    as another, however densely the values lie. A single value with more rows than a range is one key."""
    cuts = rows.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    edges = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    return F.size(F.filter(edges, lambda e: e < F.col(key)))


def length_batches(
    sequences: DataFrame, batch_size: int = 32, seed: int | None = None, keys: Sequence[str] = tuple(WINDOW)
) -> DataFrame:
    """Adds ``bin``, and ``batch`` numbered within it, in key order or shuffled by ``seed``.

    The position in a bin is built from shard sizes, so a bin is never ordered in one task.
    """
    rows = sequences.withColumn("bin", length_bin())
    if seed is None:
        ranked = global_rank(rows, ["bin"], _range_of(rows, keys[0]), list(keys), "_at")
    else:
        mixed = _mixed(seed, keys)
        ranked = global_rank(rows, ["bin"], F.shiftright(mixed, 48), [mixed, *keys], "_at")
    return ranked.withColumn("batch", F.floor((F.col("_at") - 1) / batch_size)).drop("_at")


def pad_batches(batches: DataFrame, matrix: DataFrame) -> DataFrame:
    """Matrix rows of all sequences, with rows of zeros up to the longest sequence of the batch.

    ``batches`` comes from ``length_batches`` and ``matrix`` from ``sequence_matrix``. Long form: a padded
    sequence is as many rows as its batch is long, so no array grows.
    """
    longest = batches.groupBy("bin", "batch").agg(F.max("length").alias("padded_length"))
    sized = batches.select(*WINDOW, "bin", "batch", "length").join(longest, ["bin", "batch"])
    real = matrix.select(*WINDOW, "position", "features").join(sized.drop("length"), WINDOW)
    width = F.size(F.first("features"))
    zeros = matrix.groupBy(*WINDOW).agg(F.transform(F.sequence(F.lit(1), width), lambda _: F.lit(0.0)).alias("features"))
    fill = (
        sized.filter(F.col("padded_length") > F.col("length"))
        .withColumn("position", F.explode(F.sequence(F.col("length"), F.col("padded_length") - 1)))
        .drop("length")
        .join(zeros, WINDOW)
    )
    return real.unionByName(fill)


def split_sequences(
    sequences: DataFrame,
    train: float = 0.7,
    validation: float = 0.15,
    test: float = 0.15,
    seed: int = 42,
    keys: Sequence[str] = tuple(WINDOW),
) -> DataFrame:
    """Adds ``split`` with exact sizes ``int(n·ratio)``; the rest is test."""
    if abs(train + validation + test - 1.0) >= 0.01:
        raise ValueError("the shares must sum to 1")
    mixed = _mixed(seed, keys)
    ranked = global_rank(sequences, [], F.shiftright(mixed, 48), [mixed, *keys], "_at")
    # One row: the number of sequences.
    total = sequences.agg(F.count(F.lit(1)).alias("_n")).scalar()
    n_train = F.floor(total * F.lit(train))
    n_val = F.floor(total * F.lit(validation))
    return ranked.withColumn(
        "split",
        F.when(F.col("_at") <= n_train, "train").when(F.col("_at") <= n_train + n_val, "validation").otherwise("test"),
    ).drop("_at")


# --- quality ------------------------------------------------------------------------------


def sequence_length_stats(sequences: DataFrame) -> DataFrame:
    n = F.col("length")
    sums = sequences.agg(
        F.count(F.lit(1)).alias("sequences"),
        F.min(n).alias("min_length"),
        F.max(n).alias("max_length"),
        F.avg(n).alias("mean_length"),
        F.stddev_pop(n).alias("std_length"),
        F.count_if(n < 2).alias("below_2"),
        F.count_if(n.between(2, 4)).alias("from_2_to_4"),
        F.count_if(n.between(5, 8)).alias("from_5_to_8"),
        F.count_if(n.between(9, 50)).alias("from_9_to_50"),
        F.count_if(n > 50).alias("above_50"),
    )
    median = exact_percentiles(sequences, [], "length", {"median_length": 0.5})
    return sums.withColumn("k", F.lit(1)).join(median.withColumn("k", F.lit(1)), "k").drop("k")


def sequence_checks(sequences: DataFrame, matrix: DataFrame) -> DataFrame:
    """Issue rows: type, how many sequences, and the longest length. ``matrix`` holds their matrix rows."""
    n = F.col("length")
    widths = matrix.agg(F.count_distinct(F.size("features")).alias("widths"))
    # Two one-row tables.
    sums = sequences.agg(
        F.max(n).alias("longest"),
        F.count_if(n > 100).alias("long_sequences"),
        F.count_if(n < 2).alias("short_sequences"),
        F.count_if(n > 8).alias("unexpected_long_sequences"),
        F.count_distinct(F.when(F.col("target_lat").isNotNull() & F.col("target_lon").isNotNull(), 2).otherwise(1)).alias("shapes"),
    )
    sums = sums.withColumn("_k", F.lit(1)).join(widths.withColumn("_k", F.lit(1)), "_k").drop("_k")
    # The names of the issues.
    issues = F.array(
        F.struct(F.lit("inconsistent_feature_dims").alias("issue"), F.when(F.col("widths") > 1, F.col("widths")).otherwise(0).alias("count")),
        *[F.struct(F.lit(c).alias("issue"), F.col(c).alias("count")) for c in ("long_sequences", "short_sequences", "unexpected_long_sequences")],
        F.struct(F.lit("inconsistent_target_shapes").alias("issue"), F.when(F.col("shapes") > 1, F.col("shapes")).otherwise(0).alias("count")),
    )
    rows = sums.select(F.inline(issues), F.col("longest").cast("long").alias("max_length"))
    return rows.filter(F.col("count") > 0)


def sequence_quality(sequences: DataFrame) -> DataFrame:
    """Input and horizon figures, and three warnings."""
    horizon = hours_between("last_known_time", "prediction_time")
    has_sog, has_cog = F.col("target_sog").isNotNull(), F.col("target_cog").isNotNull()
    out = sequences.agg(
        F.count(F.lit(1)).alias("sequences"),
        F.avg("length").alias("mean_points"),
        F.min("length").alias("min_points"),
        F.max("length").alias("max_points"),
        F.avg(horizon).alias("mean_horizon"),
        F.min(horizon).alias("min_horizon"),
        F.max(horizon).alias("max_horizon"),
        (F.avg(has_sog.cast("int")) * 100).alias("pct_sog"),
        (F.avg(has_cog.cast("int")) * 100).alias("pct_cog"),
    )
    return out.withColumns(
        {
            "low_points": F.col("mean_points") < 3,
            "low_horizon": F.col("mean_horizon") < 24,
            "low_sog": F.col("pct_sog") < 50,
        }
    )
