"""The eight anomaly detectors, each over all loaded days in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmtrace.functions.geo import haversine_nm, wrap_180
from helmtrace.functions.times import hours_between, micros, minutes_between
from helmtrace.operators.days import vessel_days
from helmtrace.operators.spread import order_struct
from helmtrace.operators.zones import pings_in_zones
from helmtrace.schemas import ANOMALY_SCHEMA, PING_COLUMNS, Params

# Fixed values: (speed, position, course) flags of each type.
FLAGS = {
    "AIS_Beacon_On": (False, True, False),
    "AIS_Beacon_Off": (False, True, False),
    "Speed": (True, False, False),
    "Course": (False, False, True),
    "Loitering": (False, True, False),
    "Rendezvous": (False, True, False),
    "Identity_Spoofing": (False, False, False),
    "Zone_Violation": (False, True, False),
}


def _only_pings(pings: DataFrame) -> DataFrame:
    return pings.select(*[c for c in [*PING_COLUMNS, "file_date"] if c in pings.columns])


def _stamp(kind: str, day: Column) -> list[Column]:
    speed, position, course = FLAGS[kind]
    return [
        F.lit(kind).alias("AnomalyType"),
        F.lit(speed).alias("SpeedAnomaly"),
        F.lit(position).alias("PositionAnomaly"),
        F.lit(course).alias("CourseAnomaly"),
        day.alias("Date"),
        F.date_format(day, "yyyy-MM-dd").alias("ReportDate"),
    ]


def _compared_days(pings: DataFrame, days: DataFrame, params: Params) -> DataFrame:
    """Pings of the days on which within-day detectors run (not the first loaded day)."""
    if params.include_first_day:
        return pings
    later = days.filter(~F.col("is_first")).select("file_date")
    return pings.join(F.broadcast(later), "file_date", "left_semi")


def anomaly_table(rows: DataFrame) -> DataFrame:
    """The full anomaly layout; columns a detector does not set are null."""
    have = set(rows.columns)
    return rows.selectExpr(
        *[
            f"CAST({f'`{f.name}`' if f.name in have else 'NULL'} AS {f.dataType.simpleString()}) AS `{f.name}`"
            for f in ANOMALY_SCHEMA.fields
        ]
    )


# --- between consecutive days -------------------------------------------------------------


def _beacon_on(params: Params) -> tuple[Column, Column]:
    gap = minutes_between(F.col("file_date").cast("timestamp"), "first.BaseDateTime")
    absent = F.col("prev_index").isNull() | (F.col("prev_index") != F.col("day_index") - 1)
    return F.col("prev_has_rows") & absent & (gap >= params.beacon_hours * 60), gap


def _beacon_off(params: Params) -> tuple[Column, Column]:
    midnight = F.col("file_date").cast("timestamp")
    gap = (micros(midnight) + F.lit(86_399_000_000) - micros("last.BaseDateTime")) / F.lit(60_000_000.0)
    absent = F.col("next_index").isNull() | (F.col("next_index") != F.col("day_index") + 1)
    return F.col("next_has_rows") & absent & (gap >= params.beacon_hours * 60), gap


def _speed(params: Params) -> tuple[Column, Column, Column, Column]:
    minutes = minutes_between("prev_last.BaseDateTime", "first.BaseDateTime")
    nm = haversine_nm("prev_last.LAT", "prev_last.LON", "first.LAT", "first.LON")
    knots = F.when((minutes == 0) & (nm > 0), F.lit(float("inf"))).otherwise(F.try_divide(nm, minutes / 60))
    adjacent = F.col("prev_index") == F.col("day_index") - 1
    hit = adjacent & (minutes <= params.time_diff_threshold_min) & (knots > params.speed_threshold)
    return hit, nm, minutes, knots


def beacon_on(pings: DataFrame, days: DataFrame, params: Params = Params()) -> DataFrame:
    hit, gap = _beacon_on(params)
    return vessel_days(_only_pings(pings), days).filter(hit).select(
        "MMSI", "first.*", "file_date", *_stamp("AIS_Beacon_On", F.col("file_date")),
        F.lit(True).alias("BeaconAnomaly"), gap.alias("BeaconGapMinutes"),
    )


def beacon_off(pings: DataFrame, days: DataFrame, params: Params = Params()) -> DataFrame:
    hit, gap = _beacon_off(params)
    return vessel_days(_only_pings(pings), days).filter(hit).select(
        "MMSI", "last.*", "file_date", *_stamp("AIS_Beacon_Off", F.col("next_date")),
        F.lit(True).alias("BeaconAnomaly"), gap.alias("BeaconGapMinutes"),
    )


def speed_jump(pings: DataFrame, days: DataFrame, params: Params = Params()) -> DataFrame:
    hit, nm, minutes, knots = _speed(params)
    return vessel_days(_only_pings(pings), days).filter(hit).select(
        "MMSI", "first.*", "file_date", *_stamp("Speed", F.col("file_date")),
        nm.alias("Distance"), minutes.alias("TimeDiff"), knots.alias("ImpliedSpeed"),
    )


def day_change_anomalies(pings: DataFrame, days: DataFrame, params: Params = Params()) -> DataFrame:
    """Beacon-on, beacon-off and speed records from one pass over the vessel-day summary."""
    on, on_gap = _beacon_on(params)
    off, off_gap = _beacon_off(params)
    fast, nm, minutes, knots = _speed(params)
    none = F.lit(None).cast("double")

    def entry(kind: str, ping: str, day: str, gap: Column, measures: tuple[Column, Column, Column]) -> Column:
        names = ("Distance", "TimeDiff", "ImpliedSpeed")
        return F.struct(
            F.col(ping).alias("ping"),
            *_stamp(kind, F.col(day)),
            F.when(F.lit(kind != "Speed"), F.lit(True)).alias("BeaconAnomaly"),
            gap.alias("BeaconGapMinutes"),
            *[m.alias(n) for m, n in zip(measures, names)],
        )

    found = F.array_compact(
        F.array(
            F.when(on, entry("AIS_Beacon_On", "first", "file_date", on_gap, (none, none, none))),
            F.when(off, entry("AIS_Beacon_Off", "last", "next_date", off_gap, (none, none, none))),
            F.when(fast, entry("Speed", "first", "file_date", none, (nm, minutes, knots))),
        )
    )
    rows = vessel_days(_only_pings(pings), days).select("MMSI", "file_date", F.inline(found))
    return rows.select("MMSI", "file_date", "ping.*", *[c for c in rows.columns if c not in ("MMSI", "file_date", "ping")])


# --- within a day -------------------------------------------------------------------------


def course_heading(pings: DataFrame, days: DataFrame, params: Params = Params()) -> DataFrame:
    rows = _compared_days(_only_pings(pings), days, params)
    if params.drop_heading_511:
        rows = rows.filter(F.col("Heading") != 511)
    turn = wrap_180(F.col("COG") - F.col("Heading"))
    return rows.filter((F.col("SOG") >= params.min_speed_for_cog) & (F.abs(turn) > params.cog_heading_max_diff)).select(
        *rows.columns, *_stamp("Course", F.col("file_date")), turn.alias("CourseHeadingDiff")
    )


def fits_latitudes(south: str, north: str, centre: str, params: Params) -> Column:
    """Whether latitudes alone allow all positions to lie within the loitering radius of the centre."""
    reach = 180.0 / 3.141592653589793 * params.loitering_radius_nm / 3440.1 + 1e-9
    return (F.col(north) - F.col(centre) <= reach) & (F.col(centre) - F.col(south) <= reach)


def loitering(pings: DataFrame, days: DataFrame, params: Params = Params()) -> DataFrame:
    """Vessel-days that stay within a radius of their mean position.

    The mean comes from a map-side combined aggregate. Only vessel-days that are long enough,
    and whose latitudes allow them to fit the circle at all, are read a second time; that
    join is keyed by hour as well, so a busy vessel-day spreads over 24 keys.
    """
    rows = _compared_days(_only_pings(pings), days, params)
    calm = (
        rows.groupBy("MMSI", "file_date")
        .agg(
            F.count(F.lit(1)).alias("LoiteringRecordCount"),
            F.min("BaseDateTime").alias("_from"),
            F.max("BaseDateTime").alias("_to"),
            F.avg("LAT").alias("_clat"),
            F.avg("LON").alias("_clon"),
            F.min("LAT").alias("_south"),
            F.max("LAT").alias("_north"),
        )
        .withColumn("LoiteringDurationHours", hours_between("_from", "_to"))
        .filter(
            (F.col("LoiteringRecordCount") >= params.loitering_min_records)
            & (F.col("LoiteringDurationHours") >= params.loitering_hours)
            & fits_latitudes("_south", "_north", "_clat", params)
        )
        .withColumn("_hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
        .drop("_from", "_to", "_south", "_north")
    )
    keys = ["MMSI", "file_date"]
    facts = ["LoiteringRecordCount", "LoiteringDurationHours"]
    near = rows.withColumn("_hour", F.hour("BaseDateTime")).join(calm, [*keys, "_hour"])
    away = haversine_nm("_clat", "_clon", "LAT", "LON")
    first = F.min(order_struct(rows, skip=keys)).alias("first")
    done = near.groupBy(*keys, *facts).agg(F.max(away).alias("LoiteringRadiusNM"), first)
    return done.filter(F.col("LoiteringRadiusNM") < params.loitering_radius_nm).select(
        "MMSI", "first.*", "file_date", *_stamp("Loitering", F.col("file_date")), "LoiteringRadiusNM", *facts
    )


def identity_spoofing(pings: DataFrame, days: DataFrame, params: Params = Params()) -> DataFrame:
    """Vessel-days with several names; all of them are listed, in order of appearance.

    Pings are combined to one row per vessel, day and name before anything is gathered.
    """
    rows = _compared_days(_only_pings(pings), days, params)
    keys = ["MMSI", "file_date"]
    names = rows.groupBy(*keys, "VesselName").agg(F.min(order_struct(rows, skip=keys)).alias("first"))
    named = F.when(F.col("VesselName").isNotNull(), F.struct("first", "VesselName"))
    several = (
        names.groupBy(*keys)
        .agg(
            F.count("VesselName").alias("NameCount"),
            F.min("first").alias("first"),
            F.array_sort(F.collect_list(named)).alias("_names"),
        )
        .filter("NameCount > 1")
    )
    return several.select(
        "MMSI", "first.*", "file_date", *_stamp("Identity_Spoofing", F.col("file_date")),
        F.lit("multiple_vessel_names").alias("SpoofingIssue"), "NameCount",
        F.array_join(F.transform("_names", lambda n: n["VesselName"]), ", ").alias("VesselNames"),
    )


def zone_violations(pings: DataFrame, days: DataFrame, zones: DataFrame, params: Params = Params()) -> DataFrame:
    """First ping of each vessel and day inside each zone."""
    rows = _compared_days(_only_pings(pings), days, params)
    inside = pings_in_zones(rows, zones)
    keys = ["MMSI", "file_date", "ZoneName", "ZoneLatMin", "ZoneLatMax", "ZoneLonMin", "ZoneLonMax"]
    first = F.min(order_struct(inside, skip=keys)).alias("first")
    return inside.groupBy(*keys).agg(first).select(
        "MMSI", "first.*", "file_date", *_stamp("Zone_Violation", F.col("file_date")), *keys[2:]
    )


# --- rendezvous: a distance self-join on an adaptive grid ----------------------------------


def _grid(params: Params) -> tuple[float, float]:
    """Distance limit as an angle, and the height of a latitude band in degrees."""
    arc = params.rendezvous_nm / 3440.1 * (1 + 1e-9) + 1e-12
    return arc, arc * 180.0 / 3.141592653589793 * 1.0001


def _lon_reach(band: Column, arc: float, height: float) -> Column:
    """Widest longitude difference of two positions within reach, one in ``band`` or beside it."""
    edge = F.greatest(F.abs(band * height - 90 - height), F.abs((band + 2) * height - 90))
    lowest = F.cos(F.radians(F.least(edge, F.lit(90.0))))
    half = F.sin(F.lit(arc / 2))
    return F.when(
        lowest > half, F.degrees(F.asin(F.least(F.lit(1.0), half / F.greatest(lowest, F.lit(1e-12))))) * 2.0001
    ).otherwise(F.lit(360.0))


def _lon_cells(band: Column, arc: float, height: float) -> Column:
    """Number of longitude cells of a band; fewer towards the poles."""
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) / _lon_reach(band, arc, height))).cast("long")


def hourly_positions(pings: DataFrame, params: Params = Params()) -> DataFrame:
    """Mean position and first ping per vessel, date and hour of day."""
    rows = _only_pings(pings).withColumn("TimeWindow", F.hour("BaseDateTime"))
    keys = ["file_date", "TimeWindow", "MMSI"]
    return (
        rows.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.avg("LAT").alias("_lat"),
            F.avg("LON").alias("_lon"),
            F.min(order_struct(rows, skip=keys)).alias("first"),
        )
        .filter(F.col("_n") >= params.rendezvous_min_records)
    )


def close_pairs(spots: DataFrame, keys: list[str], params: Params) -> DataFrame:
    """Pairs ``MMSI < MMSI2`` of the same ``keys`` closer than the limit.

    Bands of latitude as high as the limit are cut into longitude cells at least as wide as it
    can reach there; one side looks into the cells its reach touches in three bands, wrapping
    at the date line. Each pair meets exactly once, in the second vessel's cell. The first
    side is salted and the second copied per salt, so a crowded anchorage is shared out.
    """
    arc, height = _grid(params)
    salts = max(1, params.rendezvous_salts)
    band = F.floor((F.col("_lat") + 90) / height).cast("long")

    def cell(lon: Column, of: Column) -> Column:
        n = _lon_cells(of, arc, height)
        return F.floor((lon + 180) / (F.lit(360.0) / n)).cast("long")

    near = spots.withColumn("_band", F.explode(F.sequence(band - 1, band + 1)))
    width = _lon_reach(F.col("_band"), arc, height)
    count = _lon_cells(F.col("_band"), arc, height)
    lows, highs = cell(F.col("_lon") - width, F.col("_band")), cell(F.col("_lon") + width, F.col("_band"))
    span = F.least(highs, lows + count - 1)
    near = near.withColumn("_at", F.explode(F.sequence(lows, span))).select(
        *keys,
        "_band",
        F.pmod(F.col("_at"), count).alias("_cell"),
        F.pmod(F.xxhash64("MMSI"), F.lit(salts)).alias("_salt"),
        F.struct("MMSI", "_lat", "_lon", "first").alias("a"),
    )
    own_cell = F.pmod(cell(F.col("_lon"), F.col("_band")), _lon_cells(F.col("_band"), arc, height))
    other = spots.withColumn("_band", band).select(
        *keys,
        "_band",
        own_cell.alias("_cell"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_salt"),
        F.struct("MMSI", "_lat", "_lon").alias("b"),
    )
    nm = haversine_nm("a._lat", "a._lon", "b._lat", "b._lon")
    return (
        near.join(other, [*keys, "_band", "_cell", "_salt"])
        .filter((F.col("a.MMSI") < F.col("b.MMSI")) & (nm < params.rendezvous_nm))
        .withColumn("RendezvousDistanceNM", nm)
    )


def rendezvous(pings: DataFrame, days: DataFrame, params: Params = Params()) -> DataFrame:
    rows = _compared_days(_only_pings(pings), days, params)
    pairs = close_pairs(hourly_positions(rows, params), ["file_date", "TimeWindow"], params)
    return pairs.select(
        F.col("a.MMSI").alias("MMSI"),
        "a.first.*",
        "file_date",
        "TimeWindow",
        *_stamp("Rendezvous", F.col("file_date")),
        F.col("b.MMSI").alias("RendezvousMMSI2"),
        "RendezvousDistanceNM",
        ((F.col("a._lat") + F.col("b._lat")) / 2).alias("RendezvousLat"),
        ((F.col("a._lon") + F.col("b._lon")) / 2).alias("RendezvousLon"),
    )
