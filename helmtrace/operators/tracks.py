"""Tracks: time-gap segments, gaps, motion, interpolation, features.

A track is ``(MMSI, segment_id)``; ``segment_id`` counts the gaps before it, from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmtrace.functions.angles import circular_aggregates, circular_columns
from helmtrace.functions.geo import RADIUS_NM_TRACK, haversine, wrap_180
from helmtrace.functions.times import HOUR_US, chunk_of, hours_between, micros
from helmtrace.operators.spread import WALK, add_position, add_previous, bracket

TRACK = ["MMSI", "segment_id"]
# Columns a ping table may lack.
MEASUREMENTS = ("SOG", "COG", "Heading")


def with_measurements(pings: DataFrame) -> DataFrame:
    """``pings`` with null columns for the measurements it lacks."""
    return pings.withColumns({c: F.lit(None).cast("double") for c in MEASUREMENTS if c not in pings.columns})


def _chunk_width(max_gap_hours: float) -> int:
    return min(HOUR_US, max(1, int(max_gap_hours * HOUR_US)))


def _track_chunks(pings: DataFrame, max_gap_hours: float) -> DataFrame:
    """One row per vessel and chunk with its segment number.

    A chunk is no longer than the gap limit, so a track can only break between chunks: the
    chunk ends tell where, and no window has to run over pings.
    """
    width = _chunk_width(max_gap_hours)
    has_position = F.col("LAT").isNotNull(), F.col("LON").isNotNull()
    chunks = (
        with_measurements(pings).withColumn("chunk", chunk_of("BaseDateTime", width))
        .groupBy("MMSI", "chunk")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("BaseDateTime").alias("from"),
            F.max("BaseDateTime").alias("to"),
            F.max(has_position[0]).alias("has_lat"),
            F.max(has_position[1]).alias("has_lon"),
            F.count("SOG").alias("speeds"),
            F.max(F.struct("BaseDateTime", "LAT", "LON", "SOG", "COG")).alias("last"),
        )
    )
    walk = Window.partitionBy("MMSI").orderBy("chunk")
    silence = micros("from") - micros(F.lag("to").over(walk))
    chunks = chunks.withColumns(
        {
            "silence_hours": silence / F.lit(float(HOUR_US)),
            "last_before": F.lag("to").over(walk),
            "rows_before": F.coalesce(
                F.sum("n").over(walk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
            "counted_before": F.coalesce(
                F.sum("speeds").over(walk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
            "chunk_carry": F.when(silence <= int(max_gap_hours * HOUR_US), F.lag("last").over(walk)),
        }
    )
    broke = F.when(F.col("silence_hours") > max_gap_hours, 1).otherwise(0)
    upto = walk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return chunks.withColumn("segment_id", F.sum(broke).over(upto))


def _segments(chunks: DataFrame) -> DataFrame:
    return (
        chunks.groupBy(*TRACK)
        .agg(
            F.sum("n").alias("points"),
            F.min("from").alias("start"),
            F.max("to").alias("end"),
            F.max("has_lat").alias("has_lat"),
            F.max("has_lon").alias("has_lon"),
        )
        .withColumn("span_hours", hours_between("start", "end"))
    )


def _usable(min_points: int, min_hours: float) -> Column:
    return (
        (F.col("points") >= min_points) & (F.col("span_hours") >= min_hours) & F.col("has_lat") & F.col("has_lon")
    )


def track_segments(
    pings: DataFrame, max_gap_hours: float = 6.0, min_points: int = 2, min_hours: float = 1.0
) -> DataFrame:
    """One row per usable track."""
    segments = _segments(_track_chunks(pings, max_gap_hours))
    return segments.filter(_usable(min_points, min_hours)).drop("has_lat", "has_lon")


def tracks_with_size(
    pings: DataFrame,
    max_gap_hours: float = 6.0,
    min_points: int = 2,
    min_hours: float = 1.0,
    walk: bool = False,
) -> DataFrame:
    """Pings of usable tracks, with ``segment_id`` and ``segment_points``.

    With ``walk`` the rows bring along what precedes their chunk, so that ``motion_deltas`` and
    ``track_features`` go on from the same shuffle. Which tracks are usable is settled on the chunk table, so the pings of a refused track,
    however many, never reach a join key of their own.
    """
    pings = pings.filter(F.col("BaseDateTime").isNotNull())
    kept = _usable_chunks(pings, max_gap_hours, min_points, min_hours)
    return _join_chunks(pings, kept, max_gap_hours, walk, F.col("points").alias("segment_points"))


def _usable_chunks(pings: DataFrame, max_gap_hours: float, min_points: int, min_hours: float) -> DataFrame:
    """Chunks of usable tracks with their track's size.

    The windows run over chunk rows and on the partitioning the chunk table already has.
    """
    track = Window.partitionBy(*TRACK)
    chunks = _track_chunks(pings, max_gap_hours).withColumns(
        {
            "points": F.sum("n").over(track),
            "start": F.min("from").over(track),
            "end": F.max("to").over(track),
            "has_lat": F.max("has_lat").over(track),
            "has_lon": F.max("has_lon").over(track),
        }
    )
    return chunks.withColumn("span_hours", hours_between("start", "end")).filter(_usable(min_points, min_hours))


def _join_chunks(pings: DataFrame, kept: DataFrame, max_gap_hours: float, walk: bool, *extras: Column) -> DataFrame:
    kept = kept.select(
        "MMSI", F.col("chunk").alias("time_chunk"), "segment_id", *(WALK[1:] if walk else []), *extras
    )
    placed = pings.withColumn("time_chunk", chunk_of("BaseDateTime", _chunk_width(max_gap_hours)))
    joined = placed.join(kept, ["MMSI", "time_chunk"])
    return joined if walk else joined.drop("time_chunk")


def segment_tracks(
    pings: DataFrame,
    max_gap_hours: float = 6.0,
    min_points: int = 2,
    min_hours: float = 1.0,
    walk: bool = False,
) -> DataFrame:
    """Pings of usable tracks, with ``segment_id``."""
    return tracks_with_size(pings, max_gap_hours, min_points, min_hours, walk=walk).drop("segment_points")


def segment_rejections(
    pings: DataFrame, max_gap_hours: float = 6.0, min_points: int = 2, min_hours: float = 1.0
) -> DataFrame:
    """Per vessel: candidate segments, why some fail, and sizes of the rest."""
    segments = _segments(_track_chunks(pings, max_gap_hours))
    few, brief = F.col("points") < min_points, F.col("span_hours") < min_hours
    kept = ~few & ~brief
    return segments.groupBy("MMSI").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(few).alias("too_few_points"),
        F.count_if(~few & brief).alias("too_short"),
        F.count_if(kept).alias("kept"),
        *[
            f(F.when(kept, F.col(c))).alias(f"{n}_{c}")
            for c in ("points", "span_hours")
            for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))
        ],
    )


def detect_gaps(pings: DataFrame, max_gap_hours: float = 6.0) -> DataFrame:
    """Silences longer than the limit, with the positions of the pings around them."""
    chunks = _track_chunks(pings.filter(F.col("BaseDateTime").isNotNull()), max_gap_hours)
    return chunks.filter(F.col("silence_hours") > max_gap_hours).select(
        "MMSI",
        F.col("last_before").alias("start_time"),
        F.col("from").alias("end_time"),
        F.col("silence_hours").alias("duration_hours"),
        (F.col("rows_before") - 1).alias("start_index"),
        F.col("rows_before").alias("end_index"),
    )


def motion_deltas(tracks: DataFrame, keys: list[str] = TRACK, position: str | None = None) -> DataFrame:
    """Adds time step, acceleration, wrapped course change, rate of turn and distance.

    ``position`` names an optional column that counts up along the rows that have a speed.
    """
    rows = add_previous(
        with_measurements(tracks), keys, ["LAT", "LON", "SOG", "COG"], position=position, counted="SOG"
    )
    hours = hours_between("prev.BaseDateTime", "BaseDateTime")
    turn = wrap_180(F.col("COG") - F.col("prev.COG"))
    return rows.withColumns(
        {
            "dt_hours": hours,
            "acceleration": F.try_divide(F.col("SOG") - F.col("prev.SOG"), hours),
            "cog_diff": turn,
            "rate_of_turn": F.try_divide(turn, hours),
            "distance_nm": haversine("prev.LAT", "prev.LON", "LAT", "LON", RADIUS_NM_TRACK),
        }
    ).drop("prev")


def step_distance(tracks: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    rows = add_previous(tracks, keys, ["LAT", "LON"])
    return rows.withColumn(
        "distance_nm", haversine("prev.LAT", "prev.LON", "LAT", "LON", RADIUS_NM_TRACK)
    ).drop("prev")


def last_two_gap(pings: DataFrame, keys: list[str] = ["MMSI"]) -> DataFrame:
    """Hours between the last two pings; the rank limit cuts rows before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(F.col("BaseDateTime").desc())
    top = pings.select(*keys, "BaseDateTime").withColumn("_rn", F.row_number().over(newest)).filter("_rn <= 2")
    return (
        top.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), hours_between(F.min("BaseDateTime"), F.max("BaseDateTime")).alias("gap_hours"))
        .filter("_n = 2")
        .drop("_n")
    )


def latest_segment(
    pings: DataFrame, max_gap_hours: float = 6.0, min_points: int = 2, min_hours: float = 1.0
) -> DataFrame:
    """Pings of the last usable track of each vessel."""
    pings = pings.filter(F.col("BaseDateTime").isNotNull())
    kept = _usable_chunks(pings, max_gap_hours, min_points, min_hours)
    newest = F.max("segment_id").over(Window.partitionBy("MMSI"))
    kept = kept.withColumn("_newest", newest).filter(F.col("segment_id") == F.col("_newest"))
    return _join_chunks(pings, kept, max_gap_hours, False)


LINEAR = ["LAT", "LON", "SOG", "COG"]


def interpolate_tracks(
    tracks: DataFrame,
    interval_hours: float = 1.0,
    align: str = "exact",
    carried: tuple[str, ...] = ("Heading", "VesselName", "VesselType"),
) -> DataFrame:
    """A regular time grid per track.

    ``exact`` keeps only pings that lie on the grid and interpolates between those; ``linear``
    interpolates between the pings around each grid time. Other columns carry the last value
    forward. Windows run over grid rows, whose number follows the time span and not the
    reporting rate.
    """
    # Whole minutes as studied, but never none: shorter intervals count in microseconds.
    step = int(round(interval_hours * 60)) * 60_000_000 or max(1, int(interval_hours * HOUR_US))
    carried = [c for c in carried if c in tracks.columns]
    linear = [c for c in LINEAR if c in tracks.columns]
    span = tracks.groupBy(*TRACK).agg(
        F.min(micros("BaseDateTime")).alias("_t0"), F.max(micros("BaseDateTime")).alias("_t1"), F.count("*").alias("_n")
    ).filter("_n >= 2")
    grid = span.select(
        *TRACK, "_t0", F.posexplode(F.sequence("_t0", "_t1", F.lit(step))).alias("_slot", "_us")
    ).withColumn("BaseDateTime", F.timestamp_micros("_us"))
    if align == "linear":
        return _between_pings(grid, tracks, linear, carried)
    on_grid = (
        tracks.join(grid.select(*TRACK, "BaseDateTime"), [*TRACK, "BaseDateTime"], "left_semi")
        .groupBy(*TRACK, "BaseDateTime")
        .agg(F.min(F.struct(*linear, *carried)).alias("_p"))
    )
    rows = grid.join(on_grid, [*TRACK, "BaseDateTime"], "left").select(*TRACK, "BaseDateTime", "_slot", "_p.*")
    walk = Window.partitionBy(*TRACK).orderBy("_slot")
    back = walk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = walk.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = {}
    for c in linear:
        known = F.when(F.col(c).isNotNull(), F.struct("_slot", F.col(c).alias("v")))
        a, b = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(ahead)
        share = F.try_divide(F.col("_slot") - a["_slot"], b["_slot"] - a["_slot"])
        filled[c] = F.when(b.isNull(), a["v"]).when(F.col(c).isNotNull(), F.col(c)).otherwise(
            a["v"] + (b["v"] - a["v"]) * share
        )
    for c in carried:
        filled[c] = F.last(c, ignorenulls=True).over(back)
    return rows.withColumns(filled).drop("_slot")


def _between_pings(grid: DataFrame, tracks: DataFrame, linear: list[str], carried: list[str]) -> DataFrame:
    found = bracket(grid.select(*TRACK, "BaseDateTime"), tracks, TRACK, "BaseDateTime", [*linear, *carried])
    a, b = F.col("before"), F.col("after")
    share = F.try_divide(micros("BaseDateTime") - micros(a["ts"]), micros(b["ts"]) - micros(a["ts"]))
    values = {
        c: F.when(b.isNull() | share.isNull(), a[c]).otherwise(a[c] + (b[c] - a[c]) * share) for c in linear
    }
    return found.select(
        *TRACK, "BaseDateTime", *[v.alias(c) for c, v in values.items()], *[a[c].alias(c) for c in carried]
    )


def _slope(column: str, position: str) -> Column:
    """Slope over positions, which are null where the column is; 0 below two values."""
    slope = F.regr_slope(F.col(column), F.col(position).cast("double"))
    return F.when(F.count(column) < 2, F.lit(0.0)).otherwise(slope)


def linear_trend(tracks: DataFrame, column: str, keys: list[str] = TRACK) -> DataFrame:
    """Slope of a column against the position of its non-null values; 0 below two values."""
    rows = add_position(tracks, keys, "_x", counted=column)
    return rows.groupBy(*keys).agg(_slope(column, "_x").alias(f"{column.lower()}_trend"))


def track_features(tracks: DataFrame) -> DataFrame:
    """One feature row per track with at least two pings.

    Deviations are sample ones, except that of the step distance.
    """
    moved = motion_deltas(tracks, position="_x")
    extras = [c for c in ("Length", "Width") if c in tracks.columns]
    moment = F.struct("BaseDateTime", "LAT", "LON", "SOG")
    hour, weekday = F.hour("BaseDateTime"), F.weekday("BaseDateTime")

    def last_known(c: str) -> Column:
        return F.max(F.when(F.col(c).isNotNull(), F.struct("BaseDateTime", "LAT", "LON", c)))[c]

    sums = moved.groupBy(*TRACK).agg(
        F.count(F.lit(1)).alias("points"),
        F.max(moment).alias("_z"),
        F.min(F.struct("BaseDateTime", "LAT", "LON", "VesselType", *extras)).alias("_a"),
        F.avg("LAT").alias("lat_mean"),
        F.avg("LON").alias("lon_mean"),
        F.stddev_samp("LAT").alias("lat_std"),
        F.stddev_samp("LON").alias("lon_std"),
        F.avg("SOG").alias("sog_mean"),
        F.stddev_samp("SOG").alias("sog_std"),
        F.max("SOG").alias("sog_max"),
        F.min("SOG").alias("sog_min"),
        _slope("SOG", "_x").alias("sog_trend"),
        *circular_aggregates("COG", "cog"),
        *circular_aggregates("Heading", "heading"),
        last_known("COG").alias("cog_last"),
        last_known("Heading").alias("heading_last"),
        F.avg("acceleration").alias("acceleration_mean"),
        F.max(F.abs("acceleration")).alias("acceleration_max"),
        F.stddev_samp("acceleration").alias("acceleration_std"),
        F.avg("rate_of_turn").alias("rate_of_turn_mean"),
        F.max(F.abs("rate_of_turn")).alias("rate_of_turn_max"),
        F.stddev_samp("rate_of_turn").alias("rate_of_turn_std"),
        F.sum("distance_nm").alias("distance_total_nm"),
        F.avg("distance_nm").alias("distance_mean_nm"),
        F.stddev_pop("distance_nm").alias("distance_std_nm"),
        F.avg(hour).alias("hour_mean"),
        F.stddev_samp(hour).alias("hour_std"),
        F.avg(weekday).alias("day_of_week_mean"),
        hours_between(F.min("BaseDateTime"), F.max("BaseDateTime")).alias("time_span_hours"),
        F.max(F.struct("BaseDateTime", "LAT", "LON", "dt_hours"))["dt_hours"].alias("time_since_last_hours"),
    ).filter("points >= 2")
    return sums.select(
        *TRACK,
        "points",
        F.col("_z.LAT").alias("last_lat"),
        F.col("_z.LON").alias("last_lon"),
        "lat_mean",
        "lon_mean",
        "lat_std",
        "lon_std",
        "sog_mean",
        "sog_std",
        "sog_max",
        "sog_min",
        F.col("_z.SOG").alias("sog_last"),
        "sog_trend",
        *circular_columns("cog"),
        "cog_last",
        *circular_columns("heading"),
        "heading_last",
        *[f"{m}_{s}" for m in ("acceleration", "rate_of_turn") for s in ("mean", "max", "std")],
        "distance_total_nm",
        "distance_mean_nm",
        "distance_std_nm",
        "hour_mean",
        "hour_std",
        F.hour("_z.BaseDateTime").alias("hour_last"),
        "day_of_week_mean",
        F.weekday("_z.BaseDateTime").alias("day_of_week_last"),
        "time_span_hours",
        "time_since_last_hours",
        F.col("_a.VesselType").alias("vessel_type"),
        *[F.col(f"_a.{c}").alias(f"vessel_{c.lower()}") for c in extras],
    )
