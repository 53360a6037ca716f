"""Cleaning and filtering of position reports (two cleaners: detection and history)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmtrace.functions.geo import haversine
from helmtrace.functions.times import HOUR_US, chunk_of, hours_between, micros
from helmtrace.operators.spread import add_previous, order_struct
from helmtrace.schemas import OPTIONAL_NUMBERS, VESSEL_CATEGORIES, VESSEL_TYPE_NAMES


def number(c: Column | str, kind: str = "double") -> Column:
    """Text or number to ``kind``; what does not parse, and NaN, become null."""
    value = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    value = F.when(~F.isnan(value), value)
    return value if kind == "double" else value.try_cast(kind)


def position_ok(speed_threshold: float = 102.0) -> Column:
    """Row test of the detection cleaner; a null speed fails."""
    return F.coalesce(
        F.col("LAT").between(-90.0, 90.0)
        & F.col("LON").between(-180.0, 180.0)
        & ~F.isnan("SOG")
        & (F.col("SOG") <= speed_threshold),
        F.lit(False),
    )


def clean_positions(pings: DataFrame, speed_threshold: float = 102.0) -> DataFrame:
    # Written as plain comparisons so that Parquet can skip row groups.
    return pings.filter(
        F.col("LAT").isNotNull()
        & F.col("LON").isNotNull()
        & (F.col("LAT") >= -90.0)
        & (F.col("LAT") <= 90.0)
        & (F.col("LON") >= -180.0)
        & (F.col("LON") <= 180.0)
        & ~F.isnan("SOG")
        & (F.col("SOG") <= speed_threshold)
    )


def vessel_type_rule(selected: Sequence[int]) -> tuple[Column | None, bool]:
    """Row test for the selected types and whether it groups by main type (decade)."""
    if not selected:
        return None, False
    exact = any(30 <= t <= 39 or 50 <= t <= 59 for t in selected)
    by_main = not exact and any(t < 100 for t in selected)
    if by_main:
        return (F.floor(F.col("VesselType") / 10) * 10).isin([int(t) for t in selected]), True
    return F.col("VesselType").isin([int(t) for t in selected]), False


def filter_vessel_types(pings: DataFrame, selected: Sequence[int]) -> DataFrame:
    """Exact match if a 30s or 50s type is selected, else by main type if any is below 100."""
    rule, by_main = vessel_type_rule(selected)
    if rule is None:
        return pings
    out = pings.filter(F.col("VesselType").isNotNull() & rule)
    if by_main:
        out = out.withColumn("MainVesselType", (F.floor(F.col("VesselType") / 10) * 10).cast("int"))
    return out


def clean_history(
    pings: DataFrame,
    max_speed: float = 100.0,
    drop_unknown: bool = False,
) -> DataFrame:
    """History cleaner: null speed and course stay; types become whole numbers, null to 0."""

    def missing_or(column: str, high: float) -> Column:
        c = F.col(column)
        return c.isNull() | F.isnan(c) | c.between(0.0, high)

    out = pings.filter(
        F.col("BaseDateTime").isNotNull()
        & F.col("LAT").between(-90.0, 90.0)
        & F.col("LON").between(-180.0, 180.0)
        & ~((F.col("LAT") == 0) & (F.col("LON") == 0))
        & missing_or("SOG", max_speed)
        & missing_or("COG", 360.0)
    )
    filled = {"VesselType": F.coalesce(F.rint(number("VesselType")), F.lit(0.0)).cast("int")}
    for c in OPTIONAL_NUMBERS:
        if c in pings.columns:
            filled[c] = F.coalesce(number(c), F.lit(0.0))
    out = out.withColumns({k: v for k, v in filled.items() if k in pings.columns})
    return drop_unknown_types(out) if drop_unknown else out


def drop_unknown_types(pings: DataFrame) -> DataFrame:
    return pings.filter(F.col("VesselType").isNotNull() & (F.col("VesselType") != 0))


def parse_types(text: str) -> list[int]:
    """``"70,71"`` or ``"70-79"`` or a mix, as whole numbers."""
    out: list[int] = []
    for part in (p.strip() for p in text.split(",")):
        if "-" in part:
            low, high = (int(x) for x in part.split("-", 1))
            out.extend(range(low, high + 1))
        elif part:
            out.append(int(part))
    return out


def select_training(
    pings: DataFrame, types: Sequence[int] | None = None, mmsi: Sequence[int] | None = None
) -> DataFrame:
    if types:
        pings = pings.filter(F.col("VesselType").isin([int(t) for t in types]))
    if mmsi:
        pings = pings.filter(F.col("MMSI").isin([int(m) for m in mmsi]))
    return pings


def filter_mmsi(table: DataFrame, mmsi: Sequence[int] | str | DataFrame | None) -> DataFrame:
    """Keeps listed vessels; a DataFrame with ``MMSI`` serves lists of any length."""
    if isinstance(mmsi, DataFrame):
        return table.join(mmsi.select("MMSI").distinct(), "MMSI", "left_semi")
    if isinstance(mmsi, str):
        mmsi = [int(m) for m in mmsi.split(",") if m.strip()]
    return table.filter(F.col("MMSI").isin([int(m) for m in mmsi])) if mmsi else table


def date_range(pings: DataFrame, start: str | date, end: str | date) -> DataFrame:
    """Rows in ``[start, end + 1 day)``; also prunes stored date partitions."""
    start = date.fromisoformat(start) if isinstance(start, str) else start
    end = date.fromisoformat(end) if isinstance(end, str) else end
    out = pings.filter(
        (F.col("BaseDateTime") >= F.lit(datetime(start.year, start.month, start.day)).cast("timestamp"))
        & (
            F.col("BaseDateTime")
            < F.lit(datetime(end.year, end.month, end.day) + timedelta(days=1)).cast("timestamp")
        )
    )
    if "file_date" in pings.columns:
        out = out.filter(F.col("file_date").between(F.lit(start), F.lit(end)))
    return out


def validate_date_range(start: str, end: str) -> tuple[bool, str | None]:
    """Both dates parse and are in order."""
    try:
        first, last = date.fromisoformat(start), date.fromisoformat(end)
    except ValueError as error:
        return False, f"not a date: {error}"
    if first > last:
        return False, "the start lies after the end"
    return True, None


def dedup_pings(pings: DataFrame) -> DataFrame:
    """One row per vessel and time: the first by position, then by the other columns.

    ``min`` over a struct combines on the map side, so copies of one report never meet in a
    single task before they are merged.
    """
    keys = ["MMSI", "BaseDateTime"]
    first = F.min(order_struct(pings, skip=keys)).alias("_first")
    return pings.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*pings.columns)


def recent_window(pings: DataFrame, hours: float = 24.0) -> DataFrame:
    """Per vessel, the pings within ``hours`` of its own last one; two are needed."""
    width = int(hours * HOUR_US)
    newest = Window.partitionBy("MMSI").orderBy(F.col("BaseDateTime").desc())
    top = pings.select("MMSI", "BaseDateTime").withColumn("_rn", F.row_number().over(newest)).filter("_rn <= 2")
    reach = (
        top.groupBy("MMSI")
        .agg(F.max(micros("BaseDateTime")).alias("_end"), F.min(micros("BaseDateTime")).alias("_next"), F.count("*").alias("_n"))
        .filter((F.col("_n") == 2) & (F.col("_next") >= F.col("_end") - width))
        .select("MMSI", "_end")
    )
    # One row per vessel and hour of reach: the join key spreads a busy vessel over its hours.
    begin_chunk = chunk_of(F.timestamp_micros(F.col("_end") - width))
    end_chunk = chunk_of(F.timestamp_micros(F.col("_end")))
    cells = reach.withColumn("_chunk", F.explode(F.sequence(begin_chunk, end_chunk)))
    return (
        pings.withColumn("_chunk", chunk_of("BaseDateTime"))
        .join(cells, ["MMSI", "_chunk"])
        .filter(micros("BaseDateTime") >= F.col("_end") - width)
        .drop("_chunk", "_end")
    )


def filter_outliers(tracks: DataFrame, max_speed: float = 100.0, keys: Sequence[str] = ("MMSI",)) -> DataFrame:
    """Keeps rows whose speed is unknown or plausible; implied speed only without a SOG column."""
    if "SOG" in tracks.columns:
        return tracks.filter(F.col("SOG").isNull() | F.isnan("SOG") | (F.col("SOG") <= max_speed))
    rows = add_previous(tracks, keys, ["LAT", "LON"])
    nm = haversine("prev.LAT", "prev.LON", "LAT", "LON", 3440.065)
    speed = F.try_divide(nm, hours_between("prev.BaseDateTime", "BaseDateTime"))
    return rows.filter(speed.isNull() | (speed <= max_speed)).drop("prev")


def distinct_types(table: DataFrame, column: str = "VesselType") -> DataFrame:
    return table.filter(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def vessel_type_name(code: Column | str) -> Column:
    """Name of an AIS ship type, by a map literal of the fixed codes."""
    code = F.col(code) if isinstance(code, str) else code
    pairs = [F.lit(x) for item in VESSEL_TYPE_NAMES.items() for x in item]
    known = F.try_element_at(F.create_map(*pairs), code.cast("int"))
    return F.when(
        code.isNotNull(), F.coalesce(known, F.concat(F.lit("Vessel Type "), code.cast("int").cast("string")))
    )


def label_vessel_type(table: DataFrame) -> DataFrame:
    return table.withColumn("VesselTypeName", vessel_type_name("VesselType"))


def category_of(code: Column | str) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    out = None
    for name, codes in VESSEL_CATEGORIES.items():
        test = code.isin(codes)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("Unknown")


def vessel_category(table: DataFrame) -> DataFrame:
    return table.withColumn("Category", category_of("VesselType"))


def mmsi_valid(mmsi: Column | str) -> Column:
    mmsi = F.col(mmsi) if isinstance(mmsi, str) else mmsi
    return F.coalesce(mmsi.try_cast("bigint").between(100000000, 999999999), F.lit(False))


def validate_mmsi(table: DataFrame) -> DataFrame:
    return table.withColumn("MMSIValid", mmsi_valid("MMSI"))


def narrow_types(pings: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Narrower storage types; text is dictionary-encoded by Parquet on write."""
    kinds = {"LAT": "float", "LON": "float", "SOG": "float", "COG": "float", "Heading": "float", "VesselType": "smallint"}
    out = pings.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items() if c in pings.columns})
    return out.select(*keep) if keep else out
