"""Per-vessel statistics, joins of vessels with their anomalies, clustering features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helmtrace.functions.angles import circular_aggregates
from helmtrace.functions.times import hours_between, whole_days_plus_one
from helmtrace.operators.anomalies import count_by
from helmtrace.operators.cleaning import category_of, date_range, vessel_type_name
from helmtrace.operators.spread import exact_percentiles, modal_value
from helmtrace.schemas import ANOMALY_REPORT_NAMES, ANOMALY_TYPES, OPTIONAL_NUMBERS


def first_value(df: DataFrame, keys: Sequence[str], value: str, name: str | None = None) -> DataFrame:
    """First non-null value per key by (time, position, value)."""
    pick = F.min(F.struct("BaseDateTime", "LAT", "LON", value))
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(pick[value].alias(name or value))


def anomaly_counts(anomalies: DataFrame, types: Sequence[str] = tuple(ANOMALY_TYPES)) -> DataFrame:
    """Per vessel: all anomalies and one column per type, in one aggregation."""
    return anomalies.groupBy("MMSI").agg(
        F.count(F.lit(1)).alias("Anomaly_Count"),
        *[F.count_if(F.col("AnomalyType") == t).alias(f"Anomaly_{t}") for t in types],
    )


def vessel_stats(pings: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row per vessel with pings; missing anomaly counts are 0."""
    name = F.min(F.when(F.col("VesselName").isNotNull(), F.struct("BaseDateTime", "LAT", "LON", "VesselName")))
    kind = F.min(F.struct("BaseDateTime", "LAT", "LON", "VesselType"))
    seen = pings.groupBy("MMSI").agg(
        F.count(F.lit(1)).alias("Total_Records"),
        F.coalesce(name["VesselName"], F.lit("Unknown")).alias("VesselName"),
        kind["VesselType"].alias("VesselType"),
        F.min("BaseDateTime").alias("First_Seen"),
        F.max("BaseDateTime").alias("Last_Seen"),
        F.avg("SOG").alias("Avg_Speed"),
        F.max("SOG").alias("Max_Speed"),
        F.min("SOG").alias("Min_Speed"),
        F.min("LAT").alias("Min_Latitude"),
        F.max("LAT").alias("Max_Latitude"),
        F.min("LON").alias("Min_Longitude"),
        F.max("LON").alias("Max_Longitude"),
    )
    seen = seen.withColumn("Days_Active", F.coalesce(whole_days_plus_one("First_Seen", "Last_Seen"), F.lit(0)))
    counts = anomaly_counts(anomalies)
    zero = [c for c in counts.columns if c != "MMSI"]
    return seen.join(counts, "MMSI", "left").na.fill(0, zero)


def vessel_stats_anomaly_only(anomalies: DataFrame) -> DataFrame:
    names = first_value(anomalies, ["MMSI"], "VesselName")
    return (
        anomaly_counts(anomalies)
        .join(names, "MMSI", "left")
        .withColumn("VesselName", F.coalesce("VesselName", F.lit("Unknown")))
    )


def vessel_stats_summary(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.count(F.lit(1)).alias("Total_Vessels"),
        F.count_if(F.col("Anomaly_Count") > 0).alias("Vessels_With_Anomalies"),
        F.sum("Anomaly_Count").alias("Total_Anomalies"),
        F.sum("Total_Records").alias("Total_Records"),
    )


def usual_name_and_type(*tables: DataFrame) -> DataFrame:
    """Most frequent name and type per vessel, from the first table that has one.

    Names and types of all tables are counted in one pass; ties go to the smaller value.
    """
    entries = None
    for rank, table in enumerate(tables):
        kinds = F.array(
            F.struct(F.lit("name").alias("kind"), F.nullif("VesselName", F.lit("")).alias("text"), F.lit(None).cast("int").alias("code")),
            F.struct(F.lit("type").alias("kind"), F.lit(None).cast("string").alias("text"), F.col("VesselType").cast("int").alias("code")),
        )
        part = table.select("MMSI", F.lit(rank).alias("rank"), F.inline(kinds))
        entries = part if entries is None else entries.unionAll(part)
    counts = entries.groupBy("MMSI", "rank", "kind", "text", "code").agg(F.count(F.lit(1)).alias("n"))

    def best(kind: str, value: str) -> Column:
        found = (F.col("kind") == kind) & F.col(value).isNotNull()
        return F.min(F.when(found, F.struct("rank", (-F.col("n")).alias("o"), value)))[value]

    return counts.groupBy("MMSI").agg(best("name", "text").alias("InfoName"), best("type", "code").alias("InfoType"))


def vessel_info_lookup(pings: DataFrame) -> DataFrame:
    """Most frequent name and type per vessel."""
    return usual_name_and_type(pings)


def multi_anomaly_vessels(pings: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Vessels with more than one anomaly, worst first."""
    per_type = count_by(anomalies, "MMSI", "AnomalyType", name="n")
    short = F.create_map(*[F.lit(x) for item in ANOMALY_REPORT_NAMES.items() for x in item])
    label = F.coalesce(F.try_element_at(short, F.col("AnomalyType")), F.col("AnomalyType"))
    # At most one entry per anomaly type in the list.
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "AnomalyType", label.alias("label"), "n")))
    vessels = (
        per_type.groupBy("MMSI")
        .agg(F.sum("n").alias("Total"), listed.alias("l"))
        .filter("Total > 1")
        .select(
            "MMSI",
            "Total",
            F.array_join(
                F.transform("l", lambda x: F.concat_ws(": ", x["label"], x["n"].cast("string"))), ", "
            ).alias("AnomalyCounts"),
        )
    )
    seen = pings.join(anomalies.select("MMSI").distinct(), "MMSI", "left_semi")
    code = F.col("InfoType")
    shown = F.when(
        code.isNotNull(), F.concat(code.cast("string"), F.lit(" ("), vessel_type_name(code), F.lit(")"))
    ).otherwise("Unknown")
    return (
        vessels.join(usual_name_and_type(anomalies, seen), "MMSI", "left")
        .select(
            "MMSI",
            F.coalesce("InfoName", F.lit("Unknown")).alias("VesselName"),
            shown.alias("VesselType"),
            "AnomalyCounts",
            "Total",
        )
        .orderBy(F.desc("Total"), "MMSI")
    )


def summary_overview(pings: DataFrame) -> DataFrame:
    # The distinct counts run over one row per vessel and type, not over pings.
    kinds = pings.groupBy("MMSI", "VesselType").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("VesselName").isNotNull()).alias("named")
    )
    totals = kinds.agg(
        F.sum("n").alias("Total_Records"),
        F.countDistinct("MMSI").alias("Vessels"),
        F.countDistinct("VesselType").alias("Vessel_Types"),
        F.countDistinct(F.when(F.col("named"), F.col("MMSI"))).alias("Named_Vessels"),
    )
    # One row on either side.
    top = top_vessel_types(pings, 1).select(F.lit(1).alias("k"), F.col("VesselType").alias("Most_Common_Type"))
    return totals.withColumn("k", F.lit(1)).join(top, "k", "left").drop("k").withColumn(
        "Most_Common_Type_Name", F.trim(F.split(vessel_type_name("Most_Common_Type"), ",")[0])
    )


def top_vessel_types(pings: DataFrame, n: int = 10) -> DataFrame:
    typed = pings.filter(F.col("VesselType").isNotNull())
    return count_by(typed, "VesselType").orderBy(F.desc("Count"), "VesselType").limit(n)


def vessel_type_counts(pings: DataFrame, types: Sequence[int]) -> DataFrame:
    return count_by(pings.filter(F.col("VesselType").isin(list(types))), "VesselType")


def anomalies_of_types(
    pings: DataFrame,
    anomalies: DataFrame,
    vessel_types: Sequence[int] | None = None,
    anomaly_types: Sequence[str] | None = None,
) -> DataFrame:
    """Anomalies of vessels seen with a type, and of the given kinds.

    An empty pick falls back to what was there before it; whether it is empty is decided by
    two one-row checks.
    """
    kept = anomalies
    if vessel_types:
        vessels = pings.filter(F.col("VesselType").isin(list(vessel_types))).select("MMSI").distinct()
        if not vessels.isEmpty():
            kept = anomalies.join(vessels, "MMSI", "left_semi")
    if anomaly_types:
        picked = kept.filter(F.col("AnomalyType").isin(list(anomaly_types)))
        kept = kept if picked.isEmpty() else picked
    return kept


def type_anomaly_crosstab(
    pings: DataFrame, anomalies: DataFrame, types: Sequence[str] = tuple(ANOMALY_TYPES)
) -> DataFrame:
    """Vessel type × anomaly counts; a vessel seen with two types counts under both."""
    kinds = pings.select("MMSI", "VesselType").distinct()
    per_vessel = anomaly_counts(anomalies, types)
    joined = per_vessel.join(kinds, "MMSI", "left").filter(F.col("VesselType").isNotNull())
    return joined.groupBy("VesselType").agg(*[F.sum(f"Anomaly_{t}").alias(t) for t in types])


def filter_map_scope(
    pings: DataFrame,
    anomalies: DataFrame,
    mmsi: int | None = None,
    vessel_types: Sequence[int] | None = None,
    anomaly_types: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Each condition narrows both tables."""
    if mmsi is not None:
        pings, anomalies = pings.filter(F.col("MMSI") == mmsi), anomalies.filter(F.col("MMSI") == mmsi)
    if vessel_types:
        pings = pings.filter(F.col("VesselType").isin(list(vessel_types)))
        anomalies = anomalies.join(pings.select("MMSI").distinct(), "MMSI", "left_semi")
    if anomaly_types:
        anomalies = anomalies.filter(F.col("AnomalyType").isin(list(anomaly_types)))
        if mmsi is None:
            pings = pings.join(anomalies.select("MMSI").distinct(), "MMSI", "left_semi")
    return pings, anomalies


def anomalous_vessels_split(pings: DataFrame, anomalies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pings of vessels with and without anomalies."""
    vessels = anomalies.select("MMSI").distinct()
    return pings.join(vessels, "MMSI", "left_semi"), pings.join(vessels, "MMSI", "left_anti")


def extended_period(
    pings: DataFrame, original: tuple[str, str], extended: tuple[str, str], mmsi: int | None = None
) -> DataFrame:
    """Records per vessel in two periods; a row in both counts twice."""
    rows = pings if mmsi is None else pings.filter(F.col("MMSI") == mmsi)
    both = date_range(rows, *original).withColumn("part", F.lit("o")).unionAll(
        date_range(rows, *extended).withColumn("part", F.lit("x"))
    )
    return (
        both.groupBy("MMSI")
        .agg(
            F.count_if(F.col("part") == "o").alias("Original_Period_Records"),
            F.count_if(F.col("part") == "x").alias("Extended_Period_Records"),
            F.count(F.lit(1)).alias("Total_Records"),
            F.min("BaseDateTime").alias("First_Seen"),
            F.max("BaseDateTime").alias("Last_Seen"),
        )
        .withColumn("Total_Days", whole_days_plus_one("First_Seen", "Last_Seen"))
    )


# --- clustering ---------------------------------------------------------------------------

FEATURES = ["avg_speed", "max_speed", "total_records", "lat_range", "lon_range", "vessel_type"]


def cluster_features(pings: DataFrame) -> DataFrame:
    sums = pings.groupBy("MMSI").agg(
        F.avg("SOG").alias("avg_speed"),
        F.max("SOG").alias("max_speed"),
        F.count(F.lit(1)).alias("total_records"),
        (F.max("LAT") - F.min("LAT")).alias("lat_range"),
        (F.max("LON") - F.min("LON")).alias("lon_range"),
    )
    kinds = modal_value(pings, ["MMSI"], "VesselType", "vessel_type")
    return sums.join(kinds, "MMSI", "left").na.fill(0)


def cluster_vessels(pings: DataFrame, k: int = 5, seed: int = 42, restarts: int = 10) -> DataFrame:
    """K-means on the unscaled features; the best of ``restarts`` seeds by training cost."""
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(cluster_features(pings)).persist()
    best = min(
        (KMeans(k=k, seed=seed + i).fit(vectors) for i in range(restarts)),
        key=lambda model: model.summary.trainingCost,
    )
    # Scores a fresh, unpersisted plan, so that the stored copy can be released here.
    fresh = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(cluster_features(pings))
    out = best.transform(fresh).withColumnRenamed("prediction", "Cluster").drop("features")
    vectors.unpersist()
    return out


# --- training-data reports ----------------------------------------------------------------


def data_summary(pings: DataFrame) -> DataFrame:
    """Totals, date range, nulls and which measurements exist at all."""
    nulls = [
        F.count_if(F.col(c).isNull()).alias(f"missing_{c}")
        for c in pings.columns
        if c not in ("file_date", *OPTIONAL_NUMBERS)
    ]
    return pings.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.countDistinct("MMSI").alias("unique_vessels"),
        F.min("BaseDateTime").alias("start"),
        F.max("BaseDateTime").alias("end"),
        *nulls,
        F.bool_or(F.col("SOG").isNotNull()).alias("has_sog"),
        F.bool_or(F.col("COG").isNotNull()).alias("has_cog"),
        F.bool_or(F.col("Heading").isNotNull()).alias("has_heading"),
        F.bool_or(F.coalesce(F.col("VesselType") != 0, F.lit(False))).alias("has_vessel_type"),
    )


def category_summary(pings: DataFrame) -> DataFrame:
    """Records and vessels per category, with shares of all.

    Vessels without a known category are not counted, as in the report this reproduces.
    """
    typed = pings.filter(F.col("VesselType").isNotNull()).withColumn("Category", category_of("VesselType"))
    known = F.when(F.col("Category") != "Unknown", F.col("MMSI"))
    per = typed.groupBy("Category").agg(F.count(F.lit(1)).alias("Records"), F.countDistinct(known).alias("Vessels"))
    # One row of totals.
    totals = pings.agg(F.count(F.lit(1)).alias("_r"), F.countDistinct("MMSI").alias("_v")).withColumn("k", F.lit(1))
    return (
        per.withColumn("k", F.lit(1))
        .join(F.broadcast(totals), "k")
        .select(
            "Category",
            "Records",
            "Vessels",
            (F.col("Records") / F.col("_r") * 100).alias("RecordsPct"),
            (F.col("Vessels") / F.col("_v") * 100).alias("VesselsPct"),
        )
    )


def first_type_codes(pings: DataFrame, n: int = 10) -> DataFrame:
    """Records and vessels of the first ``n`` type codes in code order."""
    typed = pings.filter(F.col("VesselType").isNotNull())
    per = typed.groupBy("VesselType").agg(F.count(F.lit(1)).alias("Records"), F.countDistinct("MMSI").alias("Vessels"))
    return per.orderBy("VesselType").limit(n)


def movement_patterns(pings: DataFrame) -> DataFrame:
    """Speed, course consistency and spread per category, and which category leads each."""
    rows = pings.withColumn("Category", category_of("VesselType")).filter(F.col("Category") != "Unknown")
    sums = rows.groupBy("Category").agg(
        F.avg("SOG").alias("speed_mean"),
        F.stddev_samp("SOG").alias("speed_std"),
        F.max("SOG").alias("speed_max"),
        *circular_aggregates("COG", "cog"),
        F.stddev_samp("LAT").alias("geographic_spread_lat"),
        F.stddev_samp("LON").alias("geographic_spread_lon"),
        (F.count(F.lit(1)) / F.countDistinct("MMSI")).alias("records_per_vessel"),
    )
    medians = exact_percentiles(rows, ["Category"], "SOG", {"speed_median": 0.5})
    out = sums.join(medians, "Category", "left").withColumn(
        "course_consistency", F.sqrt(F.col("cog_sin") * F.col("cog_sin") + F.col("cog_cos") * F.col("cog_cos"))
    ).drop("cog_sin", "cog_cos")
    return out


def leading_categories(patterns: DataFrame) -> DataFrame:
    """Category with the highest mean speed, course consistency and activity (first name on a tie)."""

    def lead(measure: str, name: str):
        best = F.min(F.struct((-F.coalesce(measure, F.lit(0.0))).alias("o"), "Category"))
        return best["Category"].alias(name)

    return patterns.agg(
        lead("speed_mean", "fastest"),
        lead("course_consistency", "most_consistent"),
        lead("records_per_vessel", "most_active"),
    )


def vessel_density(pings: DataFrame) -> DataFrame:
    """Per vessel: points, hours spanned, points per hour."""
    per = pings.groupBy("MMSI").agg(
        F.count(F.lit(1)).alias("points"), hours_between(F.min("BaseDateTime"), F.max("BaseDateTime")).alias("span_hours")
    )
    return per.withColumn("points_per_hour", F.col("points") / F.greatest("span_hours", F.lit(0.01)))


def vessel_density_summary(density: DataFrame, min_points: int = 3, min_hours: float = 24.0) -> DataFrame:
    enough, long = F.col("points") >= min_points, F.col("span_hours") >= min_hours
    totals = density.agg(
        F.count(F.lit(1)).alias("vessels"),
        F.count_if(enough).alias("enough_points"),
        F.count_if(long).alias("long_span"),
        F.count_if(enough & long).alias("both"),
        *[f(c).alias(f"{n}_{c}") for c in ("points", "span_hours") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))],
    ).withColumn("k", F.lit(1))
    for c in ("points", "span_hours"):
        quarts = exact_percentiles(density, [], c, {f"p25_{c}": 0.25, f"median_{c}": 0.5, f"p75_{c}": 0.75})
        totals = totals.join(F.broadcast(quarts.withColumn("k", F.lit(1))), "k")
    return totals.drop("k")
