"""The detection batch: clean, detect over all days, combine, filter."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmtrace.functions.geo import haversine_nm
from helmtrace.functions.times import hours_between, minutes_between

from helmtrace.operators import anomalies as A
from helmtrace.operators import detectors as D
from helmtrace.operators.cleaning import clean_positions, filter_vessel_types, position_ok, vessel_type_rule
from helmtrace.operators.days import day_table
from helmtrace.operators.spread import order_struct
from helmtrace.operators.zones import zone_table
from helmtrace.schemas import Params
from helmtrace.session import stage


def _keep(params: Params) -> Column:
    test = position_ok(params.speed_threshold)
    rule, _ = vessel_type_rule(params.selected_types())
    return test if rule is None else test & F.coalesce(rule, F.lit(False))


def prepare(pings: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Cleaned pings, and the table of listed days."""
    clean = filter_vessel_types(clean_positions(pings, params.speed_threshold), params.selected_types())
    return clean, day_table(pings, _keep(params))


HOUR = ["MMSI", "file_date", "_hour"]
DAY = ["MMSI", "file_date"]


def hourly_summary(pings: DataFrame, keep: Column) -> DataFrame:
    """One row per vessel, date, hour, name and outcome of ``keep``: counts, sums and extremes.

    All buffers are plain numbers, so the aggregate hashes and combines before its shuffle. Everything that
    detectors ask of a vessel-day or vessel-hour follows from this table.
    """
    return pings.groupBy("MMSI", "file_date", F.hour("BaseDateTime").alias("_hour"), "VesselName", keep.alias("_keep")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("LAT").alias("lat"),
        F.sum("LON").alias("lon"),
        F.min("LAT").alias("south"),
        F.max("LAT").alias("north"),
        F.min("BaseDateTime").alias("from"),
        F.max("BaseDateTime").alias("to"),
    )


def _day_walk(kept: DataFrame, days: DataFrame) -> DataFrame:
    """One row per vessel and date with the vessel's neighbouring loaded days beside it."""
    rows = (
        kept.groupBy(*DAY)
        .agg(
            F.sum("n").alias("n"),
            (F.sum("lat") / F.sum("n")).alias("_clat"),
            (F.sum("lon") / F.sum("n")).alias("_clon"),
            F.min("south").alias("south"),
            F.max("north").alias("north"),
            F.min("from").alias("from"),
            F.max("to").alias("to"),
        )
        .join(F.broadcast(days), "file_date")
    )
    walk = Window.partitionBy("MMSI").orderBy("day_index")
    return rows.withColumns(
        {
            "prev_index": F.lag("day_index").over(walk),
            "prev_day": F.lag("file_date").over(walk),
            "prev_to": F.lag("to").over(walk),
            "next_index": F.lead("day_index").over(walk),
            "first": F.struct(F.col("from").alias("BaseDateTime")),
            "last": F.struct(F.col("to").alias("BaseDateTime")),
        }
    )


def _at(rows: DataFrame, day: str = "file_date", time: str = "from", mmsi: str = "MMSI") -> DataFrame:
    return rows.select(F.col(mmsi).alias("MMSI"), F.col(day).alias("file_date"), F.col(time).alias("at"))


def _told(rows: DataFrame, kind: str, *details: str | Column, last: bool = False, time: str = "from", date: str = "file_date") -> DataFrame:
    """Records of a kind without their ping: when it was, and whether the last row of that time is meant."""
    return rows.select(*DAY, F.col(time).alias("at"), F.lit(last).alias("_last"), *D._stamp(kind, F.col(date)), *details)


def shared_anomalies(pings: DataFrame, keep: Column, summary: DataFrame, days: DataFrame, params: Params) -> list[DataFrame]:
    """Records of the detectors that need few whole rows: beacons, speed, loitering, rendezvous, identity.

    They are settled on the summary as far as it goes. What is left asks for single rows (a first or last
    ping) or for all rows of a calm vessel-day; one read of the pings, joined with all asks by vessel, date and
    hour, answers them together.
    """
    on = set(params.enabled_types)
    kept = summary.filter("_keep AND _hour IS NOT NULL")
    walk = stage(_day_walk(kept, days), "vessel-days")
    inner = D._compared_days(kept, days, params)
    whole_days = D._compared_days(walk, days, params)
    hits, wanted, calm = {}, [], None
    if "AIS_Beacon_On" in on:
        hit, gap = D._beacon_on(params)
        hits["AIS_Beacon_On"] = walk.withColumn("gap", gap).filter(hit)
        wanted.append(_at(hits["AIS_Beacon_On"]))
    if "AIS_Beacon_Off" in on:
        hit, gap = D._beacon_off(params)
        hits["AIS_Beacon_Off"] = walk.withColumn("gap", gap).filter(hit)
        wanted.append(_at(hits["AIS_Beacon_Off"], time="to"))
    if "Speed" in on:
        close = minutes_between("prev_to", "from") <= params.time_diff_threshold_min
        hits["Speed"] = walk.filter((F.col("prev_index") == F.col("day_index") - 1) & close)
        wanted += [_at(hits["Speed"]), _at(hits["Speed"], "prev_day", "prev_to")]
    if "Loitering" in on:
        calm = whole_days.withColumn("hours", hours_between("from", "to")).filter(
            (F.col("n") >= params.loitering_min_records)
            & (F.col("hours") >= params.loitering_hours)
            & D.fits_latitudes("south", "north", "_clat", params)
        )
        hits["Loitering"] = calm
        wanted.append(_at(calm))
    if "Identity_Spoofing" in on:
        names = inner.filter(F.col("VesselName").isNotNull()).groupBy(*DAY, "VesselName").agg(F.min("from").alias("since"))
        several = (
            names.groupBy(*DAY)
            .agg(F.count(F.lit(1)).alias("NameCount"), F.array_sort(F.collect_list(F.struct("since", "VesselName"))).alias("_names"))
            .filter("NameCount > 1")
        )
        hits["Identity_Spoofing"] = stage(several.join(whole_days.select(*DAY, "from"), DAY), "names")
        wanted.append(_at(hits["Identity_Spoofing"]))
    if "Rendezvous" in on:
        spots = (
            inner.groupBy(*DAY, F.col("_hour").alias("TimeWindow"))
            .agg(
                F.sum("n").alias("_n"), (F.sum("lat") / F.sum("n")).alias("_lat"), (F.sum("lon") / F.sum("n")).alias("_lon"),
                F.struct(F.min("from").alias("at")).alias("first"),
            )
            .filter(F.col("_n") >= params.rendezvous_min_records)
        )
        pairs = D.close_pairs(spots, ["file_date", "TimeWindow"], params)
        hits["Rendezvous"] = stage(
            pairs.select(
                F.col("a.MMSI").alias("MMSI"), "file_date", "TimeWindow", F.col("a.first.at").alias("from"),
                F.col("b.MMSI").alias("RendezvousMMSI2"), "RendezvousDistanceNM",
                ((F.col("a._lat") + F.col("b._lat")) / 2).alias("RendezvousLat"),
                ((F.col("a._lon") + F.col("b._lon")) / 2).alias("RendezvousLon"),
            ),
            "pairs",
        )
        wanted.append(_at(hits["Rendezvous"]))
    if not wanted:
        return []
    asks = reduce(DataFrame.unionAll, wanted).withColumn("_hour", F.hour("at")).withColumns(
        {"_clat": F.lit(None).cast("double"), "_clon": F.lit(None).cast("double")}
    )
    if calm is not None:
        hours = calm.withColumn("_hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
        asks = asks.unionByName(hours.select(*HOUR, F.lit(None).cast("timestamp").alias("at"), "_clat", "_clon"))
    # Each time asked for is the first or the last of its vessel's hour, so the two ends are all of them; plain
    # numbers, so the aggregate hashes.
    asks = asks.groupBy(*HOUR).agg(
        F.min("at").alias("_low"), F.max("at").alias("_high"), F.max("_clat").alias("_clat"), F.max("_clon").alias("_clon")
    )
    asked = (F.col("BaseDateTime") == F.col("_low")) | (F.col("BaseDateTime") == F.col("_high"))
    rows = D._only_pings(pings.filter(keep))
    met = rows.withColumn("_hour", F.hour("BaseDateTime")).join(asks, HOUR).filter(asked | F.col("_clat").isNotNull())
    met = stage(met, "asked-rows")
    row = order_struct(rows, skip=DAY)
    found = stage(
        met.filter(asked).groupBy(*DAY, F.col("BaseDateTime").alias("at")).agg(F.min(row).alias("low"), F.max(row).alias("high")), "found-rows"
    )

    def with_row(table: DataFrame, day: str, time: str, pick: str, name: str) -> DataFrame:
        one = found.select(F.col("MMSI").alias("_m"), F.col("file_date").alias("_d"), F.col("at").alias("_t"), F.col(pick).alias(name))
        return table.join(one, (table["MMSI"] == F.col("_m")) & (table[day] == F.col("_d")) & (table[time] == F.col("_t"))).drop("_m", "_d", "_t")

    # Records that need one whole row each meet the found rows in one join, whatever their kind.
    told = []
    for kind, last, time, date in (("AIS_Beacon_On", False, "from", "file_date"), ("AIS_Beacon_Off", True, "to", "next_date")):
        if kind in hits:
            told.append(_told(hits[kind], kind, F.lit(True).alias("BeaconAnomaly"), F.col("gap").alias("BeaconGapMinutes"), last=last, time=time, date=date))
    parts = []
    if "Speed" in hits:
        table = with_row(hits["Speed"].drop("first", "last"), "file_date", "from", "low", "first")
        table = with_row(table, "prev_day", "prev_to", "high", "prev_last")
        hit, nm, minutes, knots = D._speed(params)
        parts.append(
            table.filter(hit).select(
                "MMSI", "first.*", "file_date", *D._stamp("Speed", F.col("file_date")),
                nm.alias("Distance"), minutes.alias("TimeDiff"), knots.alias("ImpliedSpeed"),
            )
        )
    if "Loitering" in hits:
        away = haversine_nm("_clat", "_clon", "LAT", "LON")
        far = met.filter(F.col("_clat").isNotNull()).groupBy(*DAY).agg(F.max(away).alias("LoiteringRadiusNM"))
        near = calm.join(far, DAY).filter(F.col("LoiteringRadiusNM") < params.loitering_radius_nm)
        told.append(
            _told(near, "Loitering", "LoiteringRadiusNM", F.col("n").alias("LoiteringRecordCount"), F.col("hours").alias("LoiteringDurationHours"))
        )
    if "Rendezvous" in hits:
        told.append(
            _told(hits["Rendezvous"], "Rendezvous", "TimeWindow", "RendezvousMMSI2", "RendezvousDistanceNM", "RendezvousLat", "RendezvousLon")
        )
    if "Identity_Spoofing" in hits:
        listed = F.array_join(F.transform("_names", lambda n: n["VesselName"]), ", ").alias("VesselNames")
        told.append(
            _told(hits["Identity_Spoofing"], "Identity_Spoofing", F.lit("multiple_vessel_names").alias("SpoofingIssue"), "NameCount", listed)
        )
    if told:
        table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), told).join(found, [*DAY, "at"])
        ping = F.when(F.col("_last"), F.col("high")).otherwise(F.col("low")).alias("ping")
        table = table.select(ping, *[c for c in table.columns if c not in ("at", "_last", "low", "high")])
        parts.append(table.select("MMSI", "ping.*", "file_date", *[c for c in table.columns if c not in ("ping", *DAY)]))
    return parts


def all_anomalies(
    pings: DataFrame, zones: Sequence[dict] | DataFrame | None = None, params: Params = Params()
) -> DataFrame:
    """Every enabled detector's records in the full anomaly layout, unfiltered.

    The pings are read four times at most, however many detectors run: for the hourly summary, for the rows
    it asks for, and once each for course and zones, which look at every row by itself. What is shared is small
    next to the pings and is stored below ``spark.checkpoint.dir`` while the plan is built.
    """
    on = set(params.enabled_types)
    keep = _keep(params)
    summary = stage(hourly_summary(pings, keep), "hourly")
    days = day_table(summary, F.col("_keep"))
    clean = filter_vessel_types(clean_positions(pings, params.speed_threshold), params.selected_types())
    parts = shared_anomalies(pings, keep, summary, days, params)
    if "Course" in on:
        parts.append(D.course_heading(clean, days, params))
    if "Zone_Violation" in on:
        parts.append(D.zone_violations(clean, days, zone_table(pings.sparkSession, zones), params))
    if not parts:
        return D.anomaly_table(clean.filter(F.lit(False)))
    return A.filter_anomaly_types(A.union_anomalies(parts), params.enabled_types)


def detect_anomalies(
    pings: DataFrame, zones: Sequence[dict] | DataFrame | None = None, params: Params = Params()
) -> DataFrame:
    return A.filter_anomalies(all_anomalies(pings, zones, params), params)
