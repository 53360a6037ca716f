"""One query per operator, over tables derived from ``events``.

``shown`` gives every result a plain form (rounded numbers, text dates, -1 for missing
whole numbers) that two engines can be compared on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helmtrace.checks.fixtures import CHECK_PARAMS, ZONES, dense_pings, pings, raw_pings, sparse_or_dense
from helmtrace.functions import angles, geo, lines, times
from helmtrace.operators import anomalies as A
from helmtrace.operators import cleaning as C
from helmtrace.operators import days as Y
from helmtrace.operators import detectors as D
from helmtrace.operators import layers as L
from helmtrace.operators import prediction as P
from helmtrace.operators import sequences as S
from helmtrace.operators import statistics as G
from helmtrace.operators import tracks as K
from helmtrace.operators import vessel_sets as W
from helmtrace.operators import vessels as V
from helmtrace.operators import zones as Z
from helmtrace.plans.detection import all_anomalies, detect_anomalies, prepare
from helmtrace.schemas import Params
from helmtrace.session import scratch_folder
from helmtrace.sources import daily, layouts, membership, stores
from helmtrace.streaming import tracks as live
from helmtrace.streaming.ingest import ingest_new_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DIGITS = 6


def _plain(name: str, kind: T.DataType) -> str:
    c = f"`{name}`"
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        # The shift keeps means of short decimals off the rounding edge.
        return f"round(CAST({c} AS DOUBLE) + 1e-9D, {DIGITS}) AS {c}"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return f"date_format({c}, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS {c}"
    if isinstance(kind, T.DateType):
        return f"date_format({c}, 'yyyy-MM-dd') AS {c}"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return f"coalesce(CAST({c} AS BIGINT), -1L) AS {c}"
    return c


def shown(df: DataFrame) -> DataFrame:
    return df.selectExpr(*[_plain(f.name, f.dataType) for f in df.schema.fields])


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf_dir: shown(fn(spark, sf_dir))
    return fn


# --- shared inputs ------------------------------------------------------------------------

_STORED: dict[tuple[str, str, str], str] = {}


def _stored(kind: str, spark: SparkSession, sf_dir: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Second-stage queries read a table the first stage wrote, once per session."""
    key = (spark.sparkContext.applicationId, kind, sf_dir)
    if key not in _STORED:
        folder = f"{scratch(spark)}/{kind}"
        make().write.parquet(folder)
        _STORED[key] = folder
    return spark.read.parquet(_STORED[key])


def make_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return all_anomalies(pings(spark, d), ZONES, CHECK_PARAMS)


def make_sequences(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return S.training_sequences(dense_pings(spark, d), work_dir=scratch(spark))


def anoms(spark: SparkSession, d: str) -> DataFrame:
    return _stored("anomalies", spark, d, lambda: make_anomalies(spark, d))


def sequence_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The stored sequences and their points."""
    made: list[DataFrame] = []

    def part(i: int) -> DataFrame:
        made.extend(() if made else make_sequences(spark, d))
        return made[i]

    return _stored("sequences", spark, d, lambda: part(0)), _stored("points", spark, d, lambda: part(1))


def seqs(spark: SparkSession, d: str) -> DataFrame:
    return sequence_tables(spark, d)[0]


def matrix(spark: SparkSession, d: str) -> DataFrame:
    return S.sequence_matrix(sequence_tables(spark, d)[1])


def scratch(spark: SparkSession) -> str:
    return scratch_folder(spark, "check")


def ready(spark: SparkSession, d: str, dense: bool = False) -> tuple[DataFrame, DataFrame]:
    return prepare(dense_pings(spark, d) if dense else pings(spark, d), CHECK_PARAMS)


PING_OUT = ["MMSI", "VesselName", "VesselType", "LAT", "LON", "SOG", "COG", "Heading", "BaseDateTime"]
STAMP_OUT = ["AnomalyType", "SpeedAnomaly", "PositionAnomaly", "CourseAnomaly", "Date", "ReportDate"]


# --- detectors ----------------------------------------------------------------------------


@query
def speed_jump(s, d):
    return D.speed_jump(*ready(s, d)).select(*PING_OUT, *STAMP_OUT, "Distance", "TimeDiff", "ImpliedSpeed")


@query
def beacon_on(s, d):
    return D.beacon_on(*ready(s, d)).select(*PING_OUT, *STAMP_OUT, "BeaconAnomaly", "BeaconGapMinutes")


@query
def beacon_off(s, d):
    return D.beacon_off(*ready(s, d)).select(*PING_OUT, *STAMP_OUT, "BeaconAnomaly", "BeaconGapMinutes")


@query
def course_heading(s, d):
    return D.course_heading(*ready(s, d)).select(*PING_OUT, *STAMP_OUT, "CourseHeadingDiff")


@query
def loitering(s, d):
    return D.loitering(*ready(s, d), CHECK_PARAMS).select(
        *PING_OUT, *STAMP_OUT, "LoiteringRadiusNM", "LoiteringDurationHours", "LoiteringRecordCount"
    )


@query
def rendezvous(s, d):
    return D.rendezvous(*ready(s, d, dense=True)).select(
        *PING_OUT, *STAMP_OUT, "TimeWindow", "RendezvousMMSI2", "RendezvousDistanceNM", "RendezvousLat", "RendezvousLon"
    )


@query
def identity_spoofing(s, d):
    return D.identity_spoofing(*ready(s, d)).select(*PING_OUT, *STAMP_OUT, "SpoofingIssue", "NameCount", "VesselNames")


@query
def zone_violations(s, d):
    clean, days = ready(s, d)
    return D.zone_violations(clean, days, Z.zone_table(s, ZONES)).select(
        *PING_OUT, *STAMP_OUT, "ZoneName", "ZoneLatMin", "ZoneLatMax", "ZoneLonMin", "ZoneLonMax"
    )


ANOMALY_OUT = [*PING_OUT, "AnomalyType", "Date", "ReportDate", "RendezvousMMSI2", "ZoneName"]


@query
def union_anomalies(s, d):
    return anoms(s, d).select(*ANOMALY_OUT, "BeaconGapMinutes", "ImpliedSpeed", "CourseHeadingDiff", "NameCount",
                              "LoiteringRadiusNM", "LoiteringDurationHours", "LoiteringRecordCount", "RendezvousDistanceNM", "ZoneLatMin", "ZoneLonMax")


@query
def detect_anomalies_run(s, d):
    params = Params(
        loitering_hours=12.0, loitering_min_records=3, max_anomalies_per_vessel=3, start_hour=22, end_hour=18,
        min_latitude=24.2, max_latitude=32.6,
    )
    return detect_anomalies(pings(s, d), ZONES, params).select(*ANOMALY_OUT)


QUERIES["detect_anomalies"] = QUERIES.pop("detect_anomalies_run")


@query
def detect_anomalies_default_types(s, d):
    """No types named: pings with no type, type 0 and unlisted types take no part."""
    e = F.col("event_id")
    odd = F.when(e % 17 == 0, F.lit(None)).when(e % 19 == 0, 0).when(e % 23 == 0, 100).otherwise(F.col("VesselType"))
    rows = sparse_or_dense(s, d).withColumn("VesselType", odd.cast("int")).drop("event_id")
    params = Params(loitering_hours=12.0, loitering_min_records=3)
    return detect_anomalies(rows, ZONES, params).select(*ANOMALY_OUT)


# --- sources and sinks --------------------------------------------------------------------


def _daily_files(s: SparkSession, d: str, pattern: str, form: str, rows: DataFrame | None = None, halves: bool = True) -> str:
    """Daily files made from the test pings, named by ``pattern``.

    With ``halves`` every date has two files: those of odd vessels have their columns the other way round and
    an optional one more.
    """
    folder = scratch(s)
    rows = pings(s, d) if rows is None else rows
    odd = F.col("MMSI") % 2 == 1
    turned = rows.withColumn("Length", (F.col("MMSI") % 100).cast("double")).select("Length", *rows.columns[::-1])
    parts = {"even": rows.filter(~odd), "odd": turned.filter(odd)} if halves else {"all": rows}
    hadoop = s.sparkContext._jvm.org.apache.hadoop.fs
    for part, table in parts.items():
        stage, target = f"{folder}/stage-{part}", f"{folder}/days/{part}" if halves else f"{folder}/days"
        flat = table.withColumn("day", F.date_format("file_date", pattern)).drop("file_date")
        writer = flat.repartition("day").write.partitionBy("day")
        if form == "csv":
            writer.option("header", "true").option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(stage)
        else:
            writer.parquet(stage)
        fs = hadoop.Path(stage).getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(hadoop.Path(target))
        for status in fs.listStatus(hadoop.Path(stage)):
            name = status.getPath().getName()
            if name.startswith("day="):
                (only,) = [p.getPath() for p in fs.listStatus(status.getPath()) if p.getPath().getName().startswith("part-")]
                fs.rename(only, hadoop.Path(f"{target}/{name.removeprefix('day=')}.{form}"))
    return f"{folder}/days"


@query
def scan_days(s, d):
    folder = _daily_files(s, d, "'ais-'yyyy-MM-dd", "csv")
    return daily.scan_days(s, folder, "2024-01-05", "2024-01-20").select(*PING_OUT, "file_date", "Length")


@query
def file_report(s, d):
    """What the daily files of a range hold, as their own tasks read it; a third of the vessels' files lack a column."""
    folder = scratch(s)
    rows = pings(s, d).withColumn("day", F.date_format("file_date", "'ais-'yyyy-MM-dd'.csv'")).drop("file_date")
    for part in range(3):
        some = rows.where(F.col("MMSI") % 3 == part)
        some = some.drop("SOG") if part == 1 else some.withColumn("Length", F.lit(part)) if part == 2 else some
        some.repartition("day").write.partitionBy("day").option("header", "true").csv(f"{folder}/{part}")
    # Part files of a dated folder, which keeps its name without the partition column's.
    hadoop = s.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    for part in range(3):
        for status in fs.listStatus(hadoop.Path(f"{folder}/{part}")):
            at = status.getPath()
            if at.getName().startswith("day="):
                fs.rename(at, hadoop.Path(at.getParent(), at.getName().removeprefix("day=")))
    report = layouts.file_report(s, folder, "2024-01-04", "2024-01-25")
    width = F.size(F.from_json(F.get_json_object("layout", "$.fields"), "array<string>"))
    return report.groupBy("file_date", "format", width.alias("columns"), F.array_join("missing", ",").alias("lacking")).agg(
        F.count("*").alias("files"), F.count_if(F.col("problem").isNotNull()).alias("broken")
    )


@query
def read_pings(s, d):
    """Text values of all kinds, in files of two column orders."""
    rows = raw_pings(s, d).select(
        "MMSI",
        "VesselName",
        F.when(F.col("VesselType") == 52, "n/a").otherwise(F.col("VesselType").cast("string")).alias("VesselType"),
        F.col("LAT").cast("string").alias("LAT"),
        F.col("LON").cast("string").alias("LON"),
        F.when(F.col("SOG") == 150, "fast").otherwise(F.col("SOG").cast("string")).alias("SOG"),
        F.col("COG").cast("string").alias("COG"),
        F.when(F.col("Heading") == 90, "").otherwise(F.col("Heading").cast("string")).alias("Heading"),
        F.when(F.col("MMSI") % 7 == 0, "soon").otherwise(F.col("BaseDateTime").cast("string")).alias("BaseDateTime"),
        "file_date",
    )
    folder = _daily_files(s, d, "'ais-'yyyy-MM-dd", "csv", rows)
    return daily.read_pings(s, daily.day_files(s, folder, "2000-01-01", "2100-01-01")).select(*PING_OUT, "file_date")


@query
def ingest_daily_csv(s, d):
    folder = _daily_files(s, d, "'AIS_'yyyy_MM_dd", "csv")
    target = f"{folder}-out"
    daily.ingest_daily_csv(s, folder, target)
    return s.read.parquet(target).select(*PING_OUT, "file_date")


@query
def ingest_stream(s, d):
    folder = _daily_files(s, d, "'AIS_'yyyy_MM_dd", "csv", halves=False)
    ingest_new_files(s, folder, f"{folder}-out", f"{folder}-log").awaitTermination()
    return s.read.parquet(f"{folder}-out").select(*PING_OUT, "file_date")


def _played(s: SparkSession, d: str) -> DataFrame:
    """The test pings as a stream of files, in order of time: five days at a time, four files a batch."""
    folder, rows = scratch(s), pings(s, d)
    part = F.floor(F.datediff("file_date", F.lit("2024-01-01")) / 5)
    for number in range(6):
        rows.where(part == number).repartition(4, "MMSI").write.mode("append").parquet(folder)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(folder)


@query
def stream_gap_alerts(s, d):
    """Alerts on silences of more than six hours, by timers; a watermark of one hour."""
    folder = scratch(s)
    live.write_available(live.gap_alerts(_played(s, d)), f"{folder}/alerts", f"{folder}/log")
    return s.read.parquet(f"{folder}/alerts")


@query
def stream_tracks(s, d):
    """Tracks that closed while the pings streamed by."""
    folder = scratch(s)
    live.write_available(live.session_tracks(_played(s, d)), f"{folder}/tracks", f"{folder}/log")
    return s.read.parquet(f"{folder}/tracks")


@query
def read_history(s, d):
    folder = _daily_files(s, d, "'AIS_'yyyy_MM_dd", "parquet")
    return daily.read_history(s, folder, "2024-01-10", "2024-02-15").select(*PING_OUT, "file_date")


@query
def load_cached_range(s, d):
    return stores.load_cached_range(pings(s, d), "2024-01-03", "2024-01-12", [30, 52, 70]).select(*PING_OUT)


@query
def load_full_range(s, d):
    folder = _daily_files(s, d, "yyyy-MM-dd", "parquet")
    return daily.load_full_range(s, folder, "2024-01-02", "2024-01-09").select(*PING_OUT)


@query
def write_day_cache(s, d):
    root = scratch(s)
    clean = C.clean_positions(raw_pings(s, d))
    params, source = {"ship_types": [], "speed": 102}, [f"{d}/events.parquet"]
    stores.write_day_cache(clean, root, params, source)
    return stores.read_day_cache(s, root, params, source).select(*PING_OUT, "file_date")


@query
def history_cache(s, d):
    root = scratch(s)
    folder = stores.write_day_cache(C.clean_history(raw_pings(s, d)), root, {"max_speed": 100})
    stores.clear_cache(s, folder, "2024-01-01", "2024-01-10")
    return s.read.parquet(folder).select(*PING_OUT, "file_date", "Length")


@query
def cache_inventory(s, d):
    root = scratch(s)
    stores.write_day_cache(pings(s, d).repartition("file_date"), root, {})
    found = stores.cache_inventory(s, root)
    # The sum of the sizes the file system lists is what "megabytes" must be.
    listed = s.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    size = listed.agg(F.sum("length")).first()[0]
    return found.select("files", (F.abs(F.col("megabytes") * 1048576 - size) < 1).alias("megabytes_right"))


@query
def consolidate(s, d):
    rows = sparse_or_dense(s, d)
    e = F.col("event_id")
    stored = rows.filter(e % 3 == 0).drop("event_id")
    new = rows.filter(e % 2 == 0).withColumn("SOG", F.col("SOG") + 1).drop("event_id")
    return stores.consolidate(stored, new).select(*PING_OUT)


@query
def append_consolidated(s, d):
    """A table, and two appends of the same overlapping rows."""
    path, e = f"{scratch(s)}/all", F.col("event_id")
    rows = sparse_or_dense(s, d)
    stores.append_consolidated(s, rows.filter(e % 3 == 0).drop("event_id"), path)
    new = rows.filter(e % 2 == 0).withColumn("SOG", F.col("SOG") + 1).drop("event_id")
    for _ in range(2):
        stores.append_consolidated(s, new, path)
    return s.read.parquet(path).select(*PING_OUT)


@query
def append_indexed(s, d):
    """The appends of ``append_consolidated``, by the membership index."""
    top, e = scratch(s), F.col("event_id")
    path, index = f"{top}/all", f"{top}/index"
    rows = sparse_or_dense(s, d)
    membership.append_indexed(s, rows.filter(e % 3 == 0).drop("event_id"), path, index)
    new = rows.filter(e % 2 == 0).withColumn("SOG", F.col("SOG") + 1).drop("event_id")
    for _ in range(2):
        membership.append_indexed(s, new, path, index)
    return s.read.parquet(path).select(*PING_OUT)


@query
def possible_repeats(s, d):
    """Per date, new keys, those that are stored, and stored ones that the index does not know."""
    e, keys = F.col("event_id"), membership.KEYS
    rows = sparse_or_dense(s, d)
    stored, new = rows.filter(e % 3 == 0), rows.filter(e % 2 == 0)
    candidates = membership.possible_repeats(new, membership.filters(stored))
    known = stored.select(*keys).distinct().withColumn("stored", F.lit(True))
    asked = new.select("file_date", *keys).distinct().join(known, keys, "left")
    asked = asked.join(candidates.select(*keys).distinct().withColumn("possible", F.lit(True)), keys, "left")
    is_stored = F.coalesce("stored", F.lit(False))
    return asked.groupBy("file_date").agg(
        F.count("*").alias("asked"), F.count_if(is_stored).alias("repeats"), F.count_if(is_stored & F.col("possible").isNull()).alias("missed")
    )


@query
def vessel_set_totals(s, d):
    """Rows and distinct vessels of the week up to each date, from one stored sketch a date."""
    return W.trailing_totals(W.daily_sets(pings(s, d)))


@query
def vessel_set_range(s, d):
    """Totals of a range, from sets that were stored in two parts and merged."""
    rows, e = sparse_or_dense(s, d), F.col("event_id")
    sets = W.merge_sets(W.daily_sets(rows.filter(e % 3 == 0)), W.daily_sets(rows.filter(e % 3 != 0)))
    return W.range_totals(sets, "2024-01-03", "2024-01-12")


@query
def vessel_set_changes(s, d):
    return W.set_changes(W.daily_sets(pings(s, d)))


@query
def write_anomalies(s, d):
    folder = f"{scratch(s)}/anomalies"
    stores.write_anomalies(anoms(s, d), folder, "parquet")
    return s.read.parquet(folder).select(*ANOMALY_OUT)


@query
def load_anomalies(s, d):
    folder = f"{scratch(s)}/anomalies"
    stores.write_anomalies(anoms(s, d), folder)
    return stores.load_anomalies(s, folder).select(*ANOMALY_OUT)


@query
def export_dataset(s, d):
    folder = f"{scratch(s)}/pings"
    stores.export_dataset(pings(s, d), folder)
    back = s.read.schema(pings(s, d).schema).option("header", "true").option("timestampFormat", stores.STAMP_FORMAT)
    return back.csv(folder).select(*PING_OUT, "file_date")


@query
def write_statistics(s, d):
    folder = scratch(s)
    stores.write_statistics({"by_type": A.count_by_type(anoms(s, d))}, folder, anoms(s, d))
    counts = s.read.option("header", "true").csv(f"{folder}/by_type").select("AnomalyType", F.col("Count").cast("bigint").alias("Count"))
    rows = s.read.option("header", "true").csv(f"{folder}/anomalies")
    return rows.join(counts, "AnomalyType").select(
        F.col("day").cast("date").alias("day"), F.col("MMSI").cast("bigint").alias("MMSI"), "AnomalyType",
        *[F.col(c).cast("double").alias(c) for c in ("LAT", "LON", "SOG")], "Count",
    )


@query
def save_sequences(s, d):
    root = scratch(s)
    stores.save_sequences(seqs(s, d), root, {"hours": 24, "horizon": 48})
    return stores.load_sequences(s, root, {"hours": 24, "horizon": 48}).select(*SEQ_OUT)


# --- filters ------------------------------------------------------------------------------


@query
def clean_positions(s, d):
    return C.clean_positions(raw_pings(s, d)).select(*PING_OUT)


@query
def filter_vessel_types(s, d):
    return C.filter_vessel_types(raw_pings(s, d), [70, 80]).select(*PING_OUT, "MainVesselType")


@query
def filter_vessel_types_exact(s, d):
    return C.filter_vessel_types(raw_pings(s, d), [31, 71]).select(*PING_OUT)


@query
def filter_vessel_types_cached(s, d):
    return C.filter_vessel_types(pings(s, d), [60]).select(*PING_OUT)


@query
def filter_anomaly_types(s, d):
    return A.filter_anomaly_types(anoms(s, d), ["Speed", "Course"]).select(*ANOMALY_OUT)


@query
def filter_geo_box(s, d):
    return A.filter_geo_box(anoms(s, d), 24.0, 24.6, -83.0, -82.4).select(*ANOMALY_OUT)


@query
def filter_hours(s, d):
    return A.filter_hours(anoms(s, d), 22, 4).select(*ANOMALY_OUT)


@query
def filter_mmsi(s, d):
    return C.filter_mmsi(anoms(s, d), "366000001, 366000005,366000007").select(*ANOMALY_OUT)


@query
def cap_per_vessel(s, d):
    return A.cap_per_vessel(anoms(s, d), 5).select(*ANOMALY_OUT)


@query
def clean_history(s, d):
    return C.clean_history(raw_pings(s, d)).select(*PING_OUT, "Length")


@query
def drop_unknown_types(s, d):
    return C.drop_unknown_types(raw_pings(s, d)).select(*PING_OUT)


@query
def select_training(s, d):
    return C.select_training(pings(s, d), C.parse_types("30,70-79"), [366000000 + i for i in range(0, 60)]).select(*PING_OUT)


@query
def recent_window(s, d):
    return C.recent_window(pings(s, d)).select(*PING_OUT)


@query
def filter_outliers(s, d):
    return C.filter_outliers(raw_pings(s, d)).select(*PING_OUT)


@query
def filter_outliers_implied(s, d):
    return C.filter_outliers(pings(s, d).drop("SOG"), 100.0).select("MMSI", "LAT", "LON", "BaseDateTime")


@query
def distinct_types(s, d):
    return C.distinct_types(raw_pings(s, d))


@query
def distinct_anomaly_types(s, d):
    return C.distinct_types(anoms(s, d), "AnomalyType")


@query
def label_vessel_type(s, d):
    coded = raw_pings(s, d).withColumn("VesselType", F.when(F.col("VesselType") == 90, 95).otherwise(F.col("VesselType")))
    return C.label_vessel_type(coded).groupBy("VesselType", "VesselTypeName").count()


@query
def label_anomaly(s, d):
    rows = A.label_anomaly(anoms(s, d))
    return rows.groupBy("AnomalyType", "DisplayName", "ReportName", A.anomaly_code("DisplayName").alias("Code")).count()


@query
def vessel_category(s, d):
    return C.vessel_category(raw_pings(s, d)).groupBy("VesselType", "Category").count()


@query
def validate_mmsi(s, d):
    rows = pings(s, d).withColumn("MMSI", F.when(F.col("MMSI") % 5 == 0, F.col("MMSI") % 1000).otherwise(F.col("MMSI")))
    return C.validate_mmsi(rows).groupBy("MMSI", "MMSIValid").count()


@query
def filter_map_scope(s, d):
    p, a = L_scope(s, d)
    return p.groupBy("MMSI").agg(F.count("*").alias("n")).withColumn("part", F.lit("pings")).unionByName(
        a.groupBy("MMSI").agg(F.count("*").alias("n")).withColumn("part", F.lit("anomalies"))
    )


def L_scope(s, d):
    return V.filter_map_scope(pings(s, d), anoms(s, d), vessel_types=[30, 52, 71], anomaly_types=["Course", "Speed"])


@query
def anomalous_vessels_split(s, d):
    fast = A.filter_anomaly_types(anoms(s, d), ["Speed"])
    yes, no = V.anomalous_vessels_split(pings(s, d), fast)
    return yes.groupBy("MMSI").count().withColumn("part", F.lit("with")).unionByName(
        no.groupBy("MMSI").count().withColumn("part", F.lit("without"))
    )


# --- joins --------------------------------------------------------------------------------


@query
def type_anomaly_crosstab(s, d):
    return V.type_anomaly_crosstab(pings(s, d), anoms(s, d))


@query
def vessel_semijoin(s, d):
    return V.anomalies_of_types(pings(s, d), anoms(s, d), [30, 71], ["Course", "Loitering"]).select(*ANOMALY_OUT)


def _shifted(s, d):
    """Anomalies moved in time, so that the nearest ping is rarely their own."""
    rows = anoms(s, d)
    moved = F.timestamp_micros(F.unix_micros("BaseDateTime") + F.col("MMSI") % 7 * 3_600_000_000 - 9_000_000_000)
    return rows.withColumn("BaseDateTime", moved).withColumn("SOG", F.when(F.col("MMSI") % 2 == 0, F.col("SOG")))


@query
def nearest_ping(s, d):
    return L.nearest_ping(_shifted(s, d), pings(s, d)).select(
        "MMSI", "BaseDateTime", "AnomalyType", F.col("match.ts").alias("match_time"),
        F.col("match.LAT").alias("match_lat"), F.col("match.SOG").alias("match_sog"),
    )


@query
def anomaly_pins(s, d):
    return L.anomaly_pins(_shifted(s, d), pings(s, d))


@query
def vessel_info_lookup(s, d):
    return V.vessel_info_lookup(pings(s, d))


@query
def vessel_changes(s, d):
    clean, days = ready(s, d)
    return Y.vessel_changes(clean, days)


def _change(kind: str) -> Query:
    return lambda s, d: shown(vessel_changes_of(s, d).filter(F.col("Change") == kind).select("MMSI", "Date"))


def vessel_changes_of(s, d):
    return Y.vessel_changes(*ready(s, d))


QUERIES |= {"new_vessels": _change("new"), "lost_vessels": _change("lost"), "common_vessels": _change("common")}


# --- aggregates ---------------------------------------------------------------------------


@query
def run_statistics(s, d):
    return G.run_statistics(pings(s, d))


@query
def nulls_by_column(s, d):
    return G.nulls_by_column(raw_pings(s, d))


@query
def nulls_by_vessel(s, d):
    return G.nulls_by_vessel(raw_pings(s, d))


@query
def nulls_by_vessel_day(s, d):
    return G.nulls_by_vessel_day(raw_pings(s, d))


@query
def count_by_type(s, d):
    return A.count_by_type(anoms(s, d))


@query
def count_by_date(s, d):
    return A.count_by_date(anoms(s, d))


@query
def date_type_pivot(s, d):
    return A.date_type_pivot(anoms(s, d))


@query
def date_type_series(s, d):
    return A.date_type_series(anoms(s, d))


@query
def vessel_stats(s, d):
    return V.vessel_stats(pings(s, d), anoms(s, d))


@query
def vessel_stats_anomaly_only(s, d):
    return V.vessel_stats_anomaly_only(anoms(s, d))


@query
def vessel_stats_summary(s, d):
    return V.vessel_stats_summary(V.vessel_stats(pings(s, d), anoms(s, d)))


@query
def summary_overview(s, d):
    return V.summary_overview(pings(s, d))


@query
def anomaly_overview(s, d):
    return A.anomaly_overview(anoms(s, d))


@query
def multi_anomaly_vessels(s, d):
    return V.multi_anomaly_vessels(pings(s, d), anoms(s, d))


@query
def anomaly_timeline(s, d):
    return A.anomaly_timeline(anoms(s, d))


@query
def hourly_distribution(s, d):
    return A.hourly_distribution(anoms(s, d))


@query
def daily_distribution(s, d):
    return A.daily_distribution(anoms(s, d))


@query
def weekday_distribution(s, d):
    return A.weekday_distribution(anoms(s, d))


@query
def hour_type_crosstab(s, d):
    return A.hour_type_crosstab(anoms(s, d))


@query
def anomaly_frequency(s, d):
    return A.anomaly_frequency(anoms(s, d))


@query
def vessel_type_counts(s, d):
    return V.vessel_type_counts(pings(s, d), [30, 60, 80])


@query
def chart_aggregate(s, d):
    return A.chart_aggregate(pings(s, d), "VesselType", "mean", "SOG")


@query
def chart_value_counts(s, d):
    return A.chart_value_counts(raw_pings(s, d), "VesselName")


@query
def chart_timeline(s, d):
    return A.chart_timeline(anoms(s, d), "AnomalyType")


@query
def chart_histogram(s, d):
    return A.chart_histogram(pings(s, d), "SOG", 2.5, "VesselType")


@query
def chart_box(s, d):
    return A.chart_box(pings(s, d), "VesselType", "SOG")


@query
def cluster_features(s, d):
    return V.cluster_features(pings(s, d))


@query
def cluster_vessels(s, d):
    """Cluster numbers are arbitrary; the features, and that vessels are nearest to their own centre, are not."""
    path = f"{scratch(s)}/clusters"
    V.cluster_vessels(pings(s, d)).select("MMSI", *V.FEATURES, "Cluster").write.parquet(path)
    rows = s.read.parquet(path)
    centres = rows.groupBy("Cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"_{c}") for c in V.FEATURES])
    centres = centres.agg(F.collect_list(F.struct(*centres.columns)).alias("centres"), F.sum("n").alias("members"))  # k rows

    def far(c):
        return sum((F.pow(F.col(f) - c[f"_{f}"], 2) for f in V.FEATURES), F.lit(0.0))

    all_rows = rows.withColumn("_k", F.lit(1)).join(centres.withColumn("_k", F.lit(1)), "_k")
    own = F.filter("centres", lambda c: c["Cluster"] == F.col("Cluster"))[0]
    best = F.array_min(F.transform("centres", far))
    # Training stops a little short of the fixed point, so a few vessels may lie nearer to another centre.
    near = (F.sqrt(far(own)) <= F.sqrt(best) * 1.02 + 1e-6).cast("int")
    judged = all_rows.withColumn("_near", near)
    share = judged.agg((F.avg("_near") >= 0.98).alias("nearest"), F.count("*").alias("vessels")).withColumn("_k", F.lit(1))
    return judged.join(share, "_k").select(
        "MMSI", *V.FEATURES, (F.size("centres") <= 5).alias("few_clusters"), (F.col("members") == F.col("vessels")).alias("complete"), "nearest"
    )


@query
def data_summary(s, d):
    return V.data_summary(C.clean_history(raw_pings(s, d)))


@query
def category_summary(s, d):
    return V.category_summary(C.clean_history(raw_pings(s, d)))


@query
def first_type_codes(s, d):
    return V.first_type_codes(pings(s, d))


@query
def movement_patterns(s, d):
    return V.movement_patterns(pings(s, d))


@query
def leading_categories(s, d):
    return V.leading_categories(V.movement_patterns(pings(s, d)))


@query
def vessel_density(s, d):
    return V.vessel_density(pings(s, d))


@query
def vessel_density_summary(s, d):
    return V.vessel_density_summary(V.vessel_density(pings(s, d)))


@query
def bounds(s, d):
    return G.bounds(pings(s, d))


@query
def centroid(s, d):
    return G.centroid(pings(s, d).filter(F.col("VesselType") == 70))


@query
def extended_period(s, d):
    return V.extended_period(pings(s, d), ("2024-01-05", "2024-01-10"), ("2024-01-08", "2024-01-20"))


# --- windows, top-k -----------------------------------------------------------------------


@query
def day_index(s, d):
    return Y.day_index(pings(s, d))


@query
def first_last_ping(s, d):
    return Y.first_last_ping(pings(s, d)).select(
        "MMSI", "file_date", "n", F.col("first.BaseDateTime").alias("first_time"), F.col("first.LAT").alias("first_lat"),
        F.col("last.BaseDateTime").alias("last_time"), F.col("last.LAT").alias("last_lat"),
    )


@query
def top_vessels(s, d):
    return A.top_vessels(anoms(s, d), 15, "Course")


@query
def top20_vessels(s, d):
    return A.top_vessels(anoms(s, d), 20)


@query
def top10_vessels(s, d):
    return A.top_vessels(anoms(s, d), 10)


@query
def top10_per_type(s, d):
    return A.top_per_type(anoms(s, d))


@query
def top10_vessel_types(s, d):
    return V.top_vessel_types(pings(s, d))


@query
def dedup_pings(s, d):
    return C.dedup_pings(raw_pings(s, d)).select(*PING_OUT)


@query
def union_days(s, d):
    rows = pings(s, d)
    early = rows.filter(F.col("file_date") < "2024-01-10").drop("Heading")
    late = rows.filter(F.col("file_date") >= "2024-01-10")
    return stores.union_days([late, early]).select(*PING_OUT)


# --- tracks -------------------------------------------------------------------------------

TRACK_OUT = ["MMSI", "segment_id", "BaseDateTime", "LAT", "LON"]


def tracks(s, d):
    return K.segment_tracks(pings(s, d))


def walks(s, d):
    return K.segment_tracks(pings(s, d), walk=True)


@query
def segment_tracks(s, d):
    return tracks(s, d).select(*TRACK_OUT)


@query
def track_segments(s, d):
    return K.track_segments(pings(s, d))


@query
def segment_rejections(s, d):
    return K.segment_rejections(pings(s, d))


@query
def detect_gaps(s, d):
    return K.detect_gaps(pings(s, d))


@query
def motion_deltas(s, d):
    return K.motion_deltas(walks(s, d)).select(
        *TRACK_OUT, "dt_hours", "acceleration", "cog_diff", "rate_of_turn"
    )


@query
def step_distance(s, d):
    return K.step_distance(tracks(s, d)).select(*TRACK_OUT, "distance_nm")


@query
def last_two_gap(s, d):
    return K.last_two_gap(pings(s, d))


@query
def latest_segment(s, d):
    return K.latest_segment(pings(s, d)).select(*TRACK_OUT)


@query
def interpolate_tracks(s, d):
    rows = pings(s, d).withColumn("BaseDateTime", F.date_trunc("hour", "BaseDateTime"))
    return K.interpolate_tracks(K.segment_tracks(rows)).select(*TRACK_OUT, "SOG", "COG", "VesselType")


@query
def interpolate_tracks_linear(s, d):
    return K.interpolate_tracks(tracks(s, d), align="linear").select(*TRACK_OUT, "SOG", "COG", "VesselName")


@query
def linear_trend(s, d):
    return K.linear_trend(walks(s, d), "SOG")


@query
def track_features(s, d):
    rows = K.track_features(walks(s, d))
    # Where opposite angles cancel out, their mean is rounding noise.
    for p in ("cog", "heading"):
        sure = F.col(f"{p}_consistency") > 1e-6
        rows = rows.withColumns({f"{p}_{c}": F.when(sure, F.col(f"{p}_{c}")) for c in ("mean", "std")})
    return rows


@query
def path_points(s, d):
    return L.path_points(pings(s, d))


@query
def path_points_daily(s, d):
    return L.path_points(pings(s, d), per_day=True)


@query
def vessel_paths(s, d):
    return L.vessel_paths(pings(s, d))


@query
def vessel_paths_daily(s, d):
    return L.vessel_paths(pings(s, d), per_day=True)


@query
def heat_points(s, d):
    return L.heat_points(anoms(s, d), "Date", "AnomalyType")


@query
def heat_grid(s, d):
    return L.heat_grid(pings(s, d), "VesselType")


# --- sequences ----------------------------------------------------------------------------


@query
def window_points(s, d):
    return S.window_points(K.segment_tracks(dense_pings(s, d))).select(*TRACK_OUT, "window_no")


@query
def window_starts(s, d):
    return S.window_starts(K.segment_tracks(dense_pings(s, d))).select("MMSI", "segment_id", "span_hours", "slide_hours", "windows")


SEQ_OUT = [
    "MMSI", "segment_id", "window_no", "length", "last_known_time", "prediction_time",
    "target_lat", "target_lon", "target_sog", "target_cog",
]


@query
def training_sequences(s, d):
    rows, points = sequence_tables(s, d)
    inner = points.groupBy(*S.WINDOW).agg(
        F.sum("lat").alias("lat_sum"), F.count("*").alias("points"), F.max("position").alias("last_position")
    )
    return rows.select(*SEQ_OUT).join(inner, S.WINDOW)


@query
def sequence_target(s, d):
    rows = tracks(s, d)
    ends = rows.groupBy("MMSI", "segment_id", F.to_date("BaseDateTime").alias("day")).agg(
        F.max("BaseDateTime").alias("last_known_time")
    )
    return S.sequence_target(ends, rows, 5.0)


@query
def sequence_matrix(s, d):
    names = ("lat", "lon", "sog", "cog", "heading")
    return matrix(s, d).select(
        *S.WINDOW, F.col("position").alias("i"), *[F.col("features")[k].alias(c) for k, c in enumerate(names)],
        F.array_join("feature_columns", ",").alias("columns"),
    )


@query
def typed_vessel_semijoin(s, d):
    odd = dense_pings(s, d).withColumn("VesselType", F.when(F.col("MMSI") % 3 == 0, 0).otherwise(F.col("VesselType")))
    return S.typed_vessel_semijoin(seqs(s, d), odd).select(*SEQ_OUT)


@query
def sequences_by_category(s, d):
    return S.sequences_by_category(seqs(s, d), dense_pings(s, d))


@query
def length_batches(s, d):
    return S.length_batches(seqs(s, d)).select("MMSI", "segment_id", "window_no", "length", "bin", "batch")


@query
def length_batches_shuffled(s, d):
    rows = S.length_batches(seqs(s, d), seed=7)
    # Which sequence lands in which batch depends on the seed; sizes, bins and members are determined.
    sizes = rows.groupBy("bin", "batch").agg(F.count("*").alias("n"))
    return rows.join(sizes, ["bin", "batch"]).select(*S.WINDOW, "length", "bin", (F.col("n") <= 32).alias("fits"))


@query
def pad_sequence(s, d):
    rows = S.pad_batches(S.length_batches(seqs(s, d)), matrix(s, d))
    names = ("lat", "lon", "sog", "cog", "heading")
    return rows.select(
        *S.WINDOW, "position", "padded_length", *[F.col("features")[k].alias(c) for k, c in enumerate(names)]
    )


@query
def split_sequences(s, d):
    rows, again = S.split_sequences(seqs(s, d)), S.split_sequences(seqs(s, d).repartition(5))
    # The members of a part depend on a hash; its size, and that a second run agrees, are determined.
    both = rows.join(again.select(*S.WINDOW, F.col("split").alias("other")), S.WINDOW)
    return both.groupBy("split").agg(
        F.count("*").alias("count"), F.count_if(F.col("split") == F.col("other")).alias("stable"),
        F.count_distinct(*S.WINDOW).alias("members"),
    )


@query
def sequence_length_stats(s, d):
    return S.sequence_length_stats(seqs(s, d))


@query
def sequence_checks(s, d):
    """Some sequences and points are changed so that each of the five issues occurs."""
    n, k = F.col("length"), F.col("MMSI") % 10
    odd = seqs(s, d).withColumns(
        {
            "length": F.when(k == 0, n + 107).when(k == 1, F.lit(1).cast("long")).otherwise(n),
            "target_lat": F.when(k != 2, F.col("target_lat")),
        }
    )
    wide = F.when((k == 3) & (F.col("position") == 0), F.slice("features", 1, 3)).otherwise(F.col("features"))
    return S.sequence_checks(odd, matrix(s, d).withColumn("features", wide))


@query
def sequence_quality(s, d):
    return S.sequence_quality(seqs(s, d))


# --- prediction ---------------------------------------------------------------------------


@query
def predict_tracks(s, d):
    return P.predict_tracks(pings(s, d))


def drift(points):
    """A caller's step: the mean displacement of the window, repeated."""
    move = (points[-1, :2] - points[0, :2]) / max(1, len(points) - 1)
    return {"mean": tuple(points[-1, :2] + move), "std": (0.1, 0.1), "speed": 8.0}


@query
def predict_tracks_custom(s, d):
    return P.predict_tracks(pings(s, d), drift)


@query
def prediction_intervals(s, d):
    return P.prediction_intervals(P.predict_constant(pings(s, d)), 0.9)


def distinct_numbers(column: str, highest: int):
    """How many of the whole numbers 0 to ``highest`` a group holds, as bits: one row a group before the shuffle, not one a number."""
    bit = F.expr(f"shiftleft(1L, CAST({column} % 64 AS INT))")
    words = [F.bit_or(F.when(F.floor(F.col(column) / 64) == w, bit)) for w in range(highest // 64 + 1)]
    return sum((F.bit_count(F.coalesce(w, F.lit(0).cast("long"))) for w in words), F.lit(0)).cast("long")


@query
def sample_positions(s, d):
    """The draws are random: their number, mean and deviation are checked."""
    drawn = P.sample_positions(P.predict_constant(pings(s, d))).groupBy("MMSI", "step").agg(
        distinct_numbers("sample", 100).alias("samples"), F.avg("lat").alias("a"), F.stddev("lat").alias("b"),
        F.avg("lon").alias("c"), F.stddev("lon").alias("e"),
    )
    rows = P.predict_constant(pings(s, d)).join(drawn, ["MMSI", "step"])
    near = (F.abs(F.col("a") - F.col("lat")) < 0.7 * F.col("std_lat")) & (F.abs(F.col("c") - F.col("lon")) < 0.7 * F.col("std_lon"))
    wide = (F.col("b") / F.col("std_lat")).between(0.5, 1.5) & (F.col("e") / F.col("std_lon")).between(0.5, 1.5)
    return rows.select("MMSI", "step", "samples", near.alias("centred"), wide.alias("spread"))


def _cone(s, d):
    guess = P.predict_constant(pings(s, d), std_per_step=8.0)
    guess = guess.withColumn("course", F.when(F.col("MMSI") % 2 == 0, F.col("course")))
    guess = guess.withColumn("std_lat", F.when(F.col("MMSI") % 5 != 0, F.col("std_lat")))
    return P.prediction_cone(guess, P.last_known(pings(s, d)))


@query
def prediction_cone(s, d):
    return _cone(s, d)


@query
def uncertainty_radius(s, d):
    return P.cone_circles(_cone(s, d))


def _scored(s, d):
    """Sequences scored with a plain guess: the last point moved by a day of drift."""
    rows, points = sequence_tables(s, d)
    ends = points.groupBy(*S.WINDOW).agg(F.max(F.struct("position", "lat", "lon", "sog", "cog")).alias("last"))
    last = F.col("last")
    return rows.join(ends, S.WINDOW).select(
        "target_lat", "target_lon", "target_sog", "target_cog",
        (last["lat"] + 0.01).alias("lat"), (last["lon"] - 0.01).alias("lon"),
        (F.lit(0.02) + F.col("length") * 0.005).alias("std_lat"), F.lit(0.03).alias("std_lon"),
        (last["sog"] + 25).alias("speed"), last["cog"].alias("course"),
        (last["cog"] + 40).alias("last_course"),
    )


@query
def prediction_metrics(s, d):
    return P.prediction_metrics(_scored(s, d))


@query
def prediction_losses(s, d):
    return P.prediction_losses(_scored(s, d), max_speed=30.0, max_turn_rate=0.5)


# --- scalar functions ---------------------------------------------------------------------


@query
def haversine_nm(s, d):
    far = geo.haversine_nm("LAT", "LON", -40.0, 170.0)
    return pings(s, d).select("MMSI", "BaseDateTime", geo.haversine_nm("LAT", "LON", 24.6, -82.9).alias("nm"), far.alias("far"))


@query
def other_radii(s, d):
    radii = {"track": geo.RADIUS_NM_TRACK, "score": geo.RADIUS_NM_SCORE, "meters": geo.RADIUS_M}
    return pings(s, d).select(
        "MMSI", "BaseDateTime", *[F.round(geo.haversine("LAT", "LON", 25.0, -82.0, r), 4).alias(n) for n, r in radii.items()]
    )


@query
def initial_bearing(s, d):
    return pings(s, d).select("MMSI", "BaseDateTime", geo.initial_bearing("LAT", "LON", 25.0, -82.5).alias("bearing"))


@query
def wrap_180(s, d):
    return pings(s, d).select("MMSI", "BaseDateTime", geo.wrap_180(F.col("COG") * 3 - 540).alias("turn"))


@query
def offset_by_bearing(s, d):
    moved = geo.offset_by_bearing("LAT", "LON", "COG", F.col("SOG") * 6)
    return pings(s, d).select("MMSI", "BaseDateTime", moved["lat"].alias("lat"), moved["lon"].alias("lon"))


@query
def in_zone(s, d):
    rows = Z.pings_in_zones(pings(s, d), Z.zone_table(s, ZONES))
    return rows.select("MMSI", "BaseDateTime", "ZoneName")


@query
def zone_shapes(s, d):
    wedge = "from_json('[[24.74,-82.26],[24.7581,-82.24],[24.74,-82.24]]', 'array<array<double>>')"
    ring = F.transform(F.expr(wedge), lambda p: F.struct(p[0].alias("lat"), p[1].alias("lon")))
    return pings(s, d).select(
        "MMSI",
        "BaseDateTime",
        geo.in_rectangle("LAT", "LON", 24.0, 24.3, -83.1, -82.6).alias("in_rectangle"),
        geo.in_circle("LAT", "LON", 24.5, -82.5, 900.0).alias("in_circle"),
        geo.in_polygon("LAT", "LON", ring).alias("in_polygon"),
        F.round(geo.segment_distance_m("LAT", "LON", 24.99, -82.01, 25.02, -81.98), 3).alias("line_m"),
    )


def _inside(s, d, test):
    return pings(s, d).filter(test).select("MMSI", "BaseDateTime")


@query
def in_rectangle(s, d):
    return _inside(s, d, geo.in_rectangle("LAT", "LON", 24.0, 24.3, -83.1, -82.6))


@query
def in_circle(s, d):
    return _inside(s, d, geo.in_circle("LAT", "LON", 24.5, -82.5, 900.0))


@query
def in_polygon(s, d):
    return _inside(s, d, geo.in_polygon("LAT", "LON", geo.parse_coordinates(F.lit(ZONES[2]["coordinates"]))))


@query
def near_polyline(s, d):
    return _inside(s, d, geo.near_polyline("LAT", "LON", geo.parse_coordinates(F.lit(ZONES[3]["coordinates"])), 150.0))


@query
def zone_bounds(s, d):
    """Bounds of circles around every vessel's mean position."""
    rows = pings(s, d).groupBy("MMSI").agg(
        F.first("VesselName").alias("n"), F.avg("LAT").alias("center_lat"), F.avg("LON").alias("center_lon")
    )
    zones = rows.select(
        F.col("MMSI").cast("string").alias("name"), F.lit("circle").alias("geometry_type"), "center_lat", "center_lon",
        F.lit(5000.0).alias("radius_meters"),
    )
    return Z.zone_bounds(Z.zone_table(s, zones)).select("name", "ZoneLatMin", "ZoneLatMax", "ZoneLonMin", "ZoneLonMax")


@query
def circular_stats(s, d):
    sums = pings(s, d).groupBy("MMSI").agg(*angles.circular_aggregates("Heading", "heading"))
    return sums.select("MMSI", *angles.circular_columns("heading")).filter("heading_consistency > 1e-6")


@query
def confidence_interval(s, d):
    level = F.get(F.array(*[F.lit(x) for x in (0.68, 0.9, 0.95, 0.99, 0.8)]), (F.col("MMSI") % 5).cast("int"))
    ci = angles.confidence_interval("LAT", F.lit(0.1), level)
    return pings(s, d).select("MMSI", "BaseDateTime", ci["lower"].alias("lower"), ci["upper"].alias("upper"))


@query
def date_parts(s, d):
    t = F.col("BaseDateTime")
    return pings(s, d).select(
        "MMSI", "BaseDateTime", F.hour(t).alias("hour"), times.weekday_name(t).alias("weekday"),
        F.to_date(t).alias("day"), F.weekday(t).alias("monday_zero"),
    )


@query
def whole_days_plus_one(s, d):
    return pings(s, d).groupBy("MMSI").agg(
        times.whole_days_plus_one(F.min("BaseDateTime"), F.max("BaseDateTime")).alias("days")
    )


@query
def date_from_name(s, d):
    rows = pings(s, d)
    names = F.when(F.col("MMSI") % 3 == 0, F.date_format("file_date", "'/x/ais-'yyyy-MM-dd'.csv'")).when(
        F.col("MMSI") % 3 == 1, F.date_format("file_date", "'/x/AIS_'yyyy_MM_dd'.csv'")
    ).otherwise(F.date_format("file_date", "'/x/notes-'yyyy-MM-dd'.txt'"))
    return rows.select(names.alias("name")).distinct().select("name", times.date_from_name("name").alias("day"))


@query
def zone_json(s, d):
    v = F.col("LAT").cast("string"), F.col("LON").cast("string")
    pair = F.concat(F.lit("[["), v[0], F.lit(","), v[1], F.lit("],[1,2]]"))
    entry = F.concat(F.lit('[{"lat":'), v[0], F.lit(',"lon":'), v[1], F.lit("}]"))
    points = geo.parse_coordinates(F.when(F.col("MMSI") % 2 == 0, pair).otherwise(entry))
    return pings(s, d).select(
        "MMSI", "BaseDateTime", F.size(points).alias("n"), F.get(points, F.lit(0))["lat"].alias("lat"),
        F.get(points, F.lit(0))["lon"].alias("lon"),
    )


@query
def parse_int_list(s, d):
    text = F.concat_ws(", ", F.col("MMSI").cast("string"), F.lit(""), F.col("VesselType").cast("string"))
    return pings(s, d).select("MMSI", "BaseDateTime", lines.parse_int_list(text).alias("l")).select(
        "MMSI", "BaseDateTime", F.size("l").alias("n"), F.get("l", F.lit(1)).alias("second")
    )


@query
def chaikin_smooth(s, d):
    """The smoothed whole path of every vessel-day (a day of one vessel is gathered), as numbered points."""
    spot = F.struct("BaseDateTime", F.col("LAT").alias("lat"), F.col("LON").alias("lon"))
    paths = pings(s, d).groupBy("MMSI", "file_date").agg(F.sort_array(F.collect_list(spot)).alias("path"))
    line = F.transform("path", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    rows = paths.select("MMSI", "file_date", F.posexplode(lines.chaikin_smooth(line)).alias("i", "p"))
    return rows.select("MMSI", "file_date", "i", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


@query
def narrow_types(s, d):
    return C.narrow_types(pings(s, d), ["MMSI", "VesselType", "LAT"]).groupBy("VesselType").agg(
        F.count("*").alias("n"), F.min("LAT").alias("low")
    )


# --- generic group-by on the other tables ---------------------------------------------------


@query
def chart_aggregate_lines(s, d):
    return A.chart_aggregate(s.read.parquet(f"{d}/lineitem.parquet"), "l_returnflag", "max", "l_quantity")


@query
def nulls_by_column_customer(s, d):
    return G.nulls_by_column(s.read.parquet(f"{d}/customer.parquet"))
