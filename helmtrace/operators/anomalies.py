"""Filters, counts and charts over the anomaly table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmtrace.functions.times import overnight_hours, weekday_name
from helmtrace.operators.cleaning import filter_mmsi
from helmtrace.operators.detectors import anomaly_table
from helmtrace.operators.spread import exact_percentiles
from helmtrace.schemas import ANOMALY_LABELS, ANOMALY_REPORT_NAMES, ANOMALY_TYPES, EXTRA_LABELS, Params


def union_anomalies(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, [anomaly_table(p) for p in parts])


def filter_anomaly_types(anomalies: DataFrame, enabled: Sequence[str]) -> DataFrame:
    return anomalies.filter(F.col("AnomalyType").isin(list(enabled))) if enabled else anomalies.filter(F.lit(False))


def filter_geo_box(
    anomalies: DataFrame, lat_min: float, lat_max: float, lon_min: float, lon_max: float
) -> DataFrame:
    return anomalies.filter(F.col("LAT").between(lat_min, lat_max) & F.col("LON").between(lon_min, lon_max))


def filter_hours(anomalies: DataFrame, start: int, end: int) -> DataFrame:
    return anomalies.filter(overnight_hours("BaseDateTime", start, end))


def type_rank(column: str = "AnomalyType") -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in ANOMALY_TYPES]), F.col(column))


def cap_per_vessel(anomalies: DataFrame, limit: int = 10) -> DataFrame:
    """The first ``limit`` anomalies of each vessel: by confidence, then in report order.

    A rank filter: Spark cuts each vessel to ``limit`` rows before the shuffle.
    """
    if limit <= 0:
        return anomalies
    order = [F.col("Confidence").desc_nulls_last()] if "Confidence" in anomalies.columns else []
    order += [F.col("Date"), type_rank(), F.col("BaseDateTime"), F.col("LAT"), F.col("LON")]
    order += [F.col(c) for c in ("RendezvousMMSI2", "ZoneName") if c in anomalies.columns]
    rank = F.row_number().over(Window.partitionBy("MMSI").orderBy(*order))
    return anomalies.withColumn("_rn", rank).filter(F.col("_rn") <= limit).drop("_rn")


def filter_anomalies(anomalies: DataFrame, params: Params) -> DataFrame:
    """Box, hours, vessel list, then the cap per vessel."""
    out = filter_geo_box(
        anomalies, params.min_latitude, params.max_latitude, params.min_longitude, params.max_longitude
    )
    out = filter_hours(out, params.start_hour, params.end_hour)
    out = filter_mmsi(out, params.mmsi_list)
    return cap_per_vessel(out, params.max_anomalies_per_vessel)


def _label(column: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), column)


def label_anomaly(anomalies: DataFrame) -> DataFrame:
    kind = F.col("AnomalyType")
    return anomalies.withColumns(
        {"DisplayName": _label(kind, ANOMALY_LABELS), "ReportName": _label(kind, ANOMALY_REPORT_NAMES)}
    )


def anomaly_code(display: Column | str) -> Column:
    """Display name back to the type name."""
    display = F.col(display) if isinstance(display, str) else display
    return _label(display, {v: k for k, v in ANOMALY_LABELS.items()} | EXTRA_LABELS)


# --- counts -------------------------------------------------------------------------------


def count_by(table: DataFrame, *keys: str, name: str = "Count") -> DataFrame:
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_by_type(anomalies: DataFrame) -> DataFrame:
    return count_by(anomalies, "AnomalyType")


def count_by_date(anomalies: DataFrame) -> DataFrame:
    return count_by(anomalies, "Date").orderBy("Date")


def date_type_pivot(anomalies: DataFrame, types: Sequence[str] = tuple(sorted(ANOMALY_TYPES))) -> DataFrame:
    return anomalies.groupBy("Date").pivot("AnomalyType", list(types)).count().na.fill(0)


def date_type_series(anomalies: DataFrame, types: Sequence[str] = tuple(sorted(ANOMALY_TYPES))) -> DataFrame:
    """Long form of the pivot: every date has a row for every type."""
    wide = date_type_pivot(anomalies, types)
    return wide.unpivot("Date", list(types), "AnomalyType", "Count")


def anomaly_timeline(anomalies: DataFrame) -> DataFrame:
    return count_by(anomalies.withColumn("Day", F.to_date("Date")), "Day", "AnomalyType")


def hourly_distribution(anomalies: DataFrame) -> DataFrame:
    return count_by(anomalies.withColumn("Hour", F.hour("BaseDateTime")), "Hour").orderBy("Hour")


def daily_distribution(anomalies: DataFrame) -> DataFrame:
    return count_by(anomalies.withColumn("Day", F.to_date("BaseDateTime")), "Day")


def weekday_distribution(anomalies: DataFrame) -> DataFrame:
    """Monday to Sunday, days without anomalies as 0."""
    days = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
    spark = anomalies.sparkSession
    week = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "DayNumber int, DayOfWeek string")
    counts = count_by(anomalies.withColumn("DayOfWeek", weekday_name("BaseDateTime")), "DayOfWeek")
    return week.join(counts, "DayOfWeek", "left").na.fill(0, ["Count"]).select("DayNumber", "DayOfWeek", "Count")


def hour_type_crosstab(anomalies: DataFrame, types: Sequence[str] = tuple(sorted(ANOMALY_TYPES))) -> DataFrame:
    hours = anomalies.withColumn("Hour", F.hour("BaseDateTime"))
    return hours.groupBy("Hour").pivot("AnomalyType", list(types)).count().na.fill(0)


def anomaly_frequency(anomalies: DataFrame) -> DataFrame:
    # The window runs over one row per anomaly type.
    total = F.sum("Count").over(Window.partitionBy())
    return count_by_type(anomalies).withColumn("Percentage", F.col("Count") / total * 100)


def anomaly_overview(anomalies: DataFrame) -> DataFrame:
    """Totals and the number per type, as (Measure, Value) rows."""
    totals = anomalies.agg(
        F.count(F.lit(1)).alias("Total Anomalies"), F.countDistinct("MMSI").alias("Vessels with Anomalies")
    ).unpivot([], ["Total Anomalies", "Vessels with Anomalies"], "Measure", "Value")
    return totals.unionByName(count_by_type(anomalies).select(F.col("AnomalyType").alias("Measure"), F.col("Count").alias("Value")))


def top_vessels(anomalies: DataFrame, n: int = 10, anomaly_type: str | None = None) -> DataFrame:
    if anomaly_type is not None:
        anomalies = anomalies.filter(F.col("AnomalyType") == anomaly_type)
    return count_by(anomalies, "MMSI").orderBy(F.desc("Count"), "MMSI").limit(n)


def top_per_type(anomalies: DataFrame, n: int = 10) -> DataFrame:
    order = Window.partitionBy("AnomalyType").orderBy(F.desc("Count"), "MMSI")
    ranked = count_by(anomalies, "AnomalyType", "MMSI").withColumn("Rank", F.row_number().over(order))
    return ranked.filter(F.col("Rank") <= n)


# --- free charts --------------------------------------------------------------------------


def chart_aggregate(table: DataFrame, group_by: str, aggregation: str = "count", y: str | None = None) -> DataFrame:
    """Group-by with count, sum, mean, max or min; anything else counts."""
    functions = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}
    if aggregation in functions and y:
        return table.groupBy(group_by).agg(functions[aggregation](y).alias(y))
    return count_by(table, group_by)


def chart_value_counts(table: DataFrame, column: str) -> DataFrame:
    return count_by(table.filter(F.col(column).isNotNull()), column)


def chart_timeline(table: DataFrame, group_by: str | None = None, time: str = "BaseDateTime") -> DataFrame:
    dated = table.withColumn("Day", F.to_date(time))
    return count_by(dated, "Day", *([group_by] if group_by else []))


def chart_histogram(table: DataFrame, column: str, width: float, color: str | None = None) -> DataFrame:
    """Counts per fixed-width bucket, the bucket named by its lower end."""
    bucket = F.floor(F.col(column) / width) * width
    rows = table.filter(F.col(column).isNotNull()).withColumn("Bucket", bucket.cast("double"))
    return count_by(rows, "Bucket", *([color] if color else []))


def chart_box(table: DataFrame, x: str, y: str) -> DataFrame:
    """Five-number summary of ``y`` per value of ``x``."""
    return exact_percentiles(
        table, [x], y, {"Min": 0.0, "Q1": 0.25, "Median": 0.5, "Q3": 0.75, "Max": 1.0}
    )
