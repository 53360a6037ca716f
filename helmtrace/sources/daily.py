"""Daily report files: listing, checking, reading, ingesting."""

from __future__ import annotations

import csv
import json
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helmtrace.functions.times import date_from_name
from helmtrace.operators.cleaning import date_range, dedup_pings, number
from helmtrace.schemas import OPTIONAL_NUMBERS, OPTIONAL_TEXTS, PING_COLUMNS
from helmtrace.sources.layouts import file_report, reachable, refused, usable


def day_of_path(path: str | Column) -> Column:
    """The date in a file's name, or in the name of the folder it is a part file of."""
    path = F.col(path) if isinstance(path, str) else path
    return F.coalesce(date_from_name(path), date_from_name(F.regexp_replace(path, r"/[^/]*$", "")))


def list_days(spark: SparkSession, folder: str) -> DataFrame:
    """One row per dated file: date, path, size and format; a date may have any number of files.

    The listing is Spark's own, so it works for any Hadoop file system (``s3a://…`` with its
    credentials in the Hadoop configuration) and reads no file content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    form = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    named = files.select(day_of_path("path").alias("file_date"), "path", "length", form.alias("format"))
    return named.filter(F.col("file_date").isNotNull() & form.isin("csv", "parquet"))


def day_files(spark: SparkSession, folder: str, start: str | date, end: str | date) -> list[tuple[str, str]]:
    """(format, path) of all files of the dates in the range, in order of date and path.

    A date stored in both formats is read from both; ``load_full_range`` merges repeated reports.
    """
    start, end = str(start), str(end)
    picked = list_days(spark, folder).filter(F.col("file_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return [(r["format"], r["path"]) for r in picked.orderBy("file_date", "path").collect()]


def _csv_header(spark: SparkSession, path: str, most: int = 1 << 16) -> list[str]:
    """Column names of a CSV file: its first line, read through the Hadoop file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        line = jvm.org.apache.commons.io.IOUtils.toString(
            jvm.org.apache.commons.io.input.BoundedInputStream(stream, most), "UTF-8"
        ).split("\n", 1)[0]
    finally:
        stream.close()
    return next(csv.reader([line.lstrip("\ufeff").rstrip("\r")]), [])


def file_layouts(spark: SparkSession, files: list[tuple[str, str]]) -> dict[tuple[str, T.StructType], list[str]]:
    """Paths by format and layout; layouts come from headers and footers only, several files at a time."""

    def layout(file: tuple[str, str]) -> str:
        form, path = file
        if form == "csv":
            return T.StructType([T.StructField(c, T.StringType()) for c in _csv_header(spark, path)]).json()
        return spark.read.parquet(path).schema.json()

    with ThreadPoolExecutor(16) as pool:
        found = list(pool.map(layout, files))
    groups: dict[tuple[str, str], list[str]] = {}
    for (form, path), text in zip(files, found):
        groups.setdefault((form, text), []).append(path)
    return {(form, T.StructType.fromJson(json.loads(text))): paths for (form, text), paths in groups.items()}


def check_columns(layouts: dict[tuple[str, T.StructType], list[str]]) -> tuple[dict[tuple[str, T.StructType], list[str]], dict[str, list[str]]]:
    """Layouts with all required columns, and what the files of the others lack."""
    good, bad = {}, {}
    for key, paths in layouts.items():
        lacking = [c for c in PING_COLUMNS if c not in key[1].names]
        if lacking:
            bad |= {p: lacking for p in paths}
        else:
            good[key] = paths
    return good, bad


def read_layout(spark: SparkSession, form: str, layout: T.StructType, paths: list[str]) -> DataFrame:
    """Files of one layout. CSV columns go by the names in the files' own header, which Spark checks again."""
    if form == "csv":
        return spark.read.schema(layout).option("header", "true").option("enforceSchema", "false").csv(paths)
    return spark.read.schema(layout).parquet(*paths)


def normalise(table: DataFrame, file_date: Column | None = None) -> DataFrame:
    """Any table with the required columns in the ping layout; bad values become null."""
    missing = [c for c in PING_COLUMNS if c not in table.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    kind = dict(table.dtypes)["BaseDateTime"]
    stamp = F.col("BaseDateTime")
    stamp = F.try_to_timestamp(stamp) if kind == "string" else stamp.cast("timestamp")
    extras = [number(c).alias(c) for c in OPTIONAL_NUMBERS if c in table.columns]
    extras += [F.col(c).cast("string").alias(c) for c in OPTIONAL_TEXTS if c in table.columns]
    if file_date is None:
        file_date = F.col("file_date") if "file_date" in table.columns else F.to_date(stamp)
    return table.select(
        number("MMSI", "bigint").alias("MMSI"),
        F.col("VesselName").cast("string").alias("VesselName"),
        number("VesselType", "int").alias("VesselType"),
        *[number(c).alias(c) for c in ("LAT", "LON", "SOG", "COG", "Heading")],
        stamp.alias("BaseDateTime"),
        file_date.alias("file_date"),
        *extras,
    )


def read_pings(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    """One table over many daily files of any column order; ``file_date`` comes from the file name.

    Files without a required column are reported and left out; optional columns are null where a file lacks them.
    """
    good, bad = check_columns(file_layouts(spark, files))
    for path, missing in bad.items():
        print(f"skipped {path}: no {', '.join(missing)}")
    if not good:
        raise FileNotFoundError("no daily files")
    parts = [
        normalise(read_layout(spark, form, layout, paths), day_of_path("_metadata.file_path"))
        for (form, layout), paths in good.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_reported(spark: SparkSession, report: DataFrame) -> DataFrame:
    """Pings of the usable files of a report (``layouts.file_report``); ``layouts.refused`` has the others.

    Files of one layout are one scan; the driver gets names and layouts only.
    """
    named = usable(report).groupBy("format", "layout").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("paths").collect()
    if not named:
        raise FileNotFoundError("no daily files")
    parts = [
        normalise(read_layout(spark, r["format"], T.StructType.fromJson(json.loads(r["layout"])), r["paths"]), day_of_path("_metadata.file_path"))
        for r in named
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _scan(spark: SparkSession, folder: str, start: str | date, end: str | date, form: str | None = None) -> DataFrame:
    """Files of a range: described by tasks where these can open the store, else through Spark's own file system."""
    if not reachable(folder):
        return read_pings(spark, [(f, p) for f, p in day_files(spark, folder, start, end) if form in (None, f)])
    report = file_report(spark, folder, start, end)
    report = report.where(F.col("format") == form) if form else report
    # One read of the headers serves both the list of refused files and the scans.
    report = spark.createDataFrame(report.collect(), report.schema)
    for r in refused(report).orderBy("path").collect():
        print(f"skipped {r['path']}: {r['reason']}")
    return read_reported(spark, report)


def scan_days(spark: SparkSession, folder: str, start: str | date, end: str | date) -> DataFrame:
    """Pings of all usable daily files in an inclusive date range; ``layouts.file_report`` tells about each file."""
    return _scan(spark, folder, start, end)


def read_history(spark: SparkSession, folder: str, start: str | date, end: str | date) -> DataFrame:
    """The same for ``AIS_YYYY_MM_DD.parquet`` files and folders; missing days are skipped."""
    return _scan(spark, folder, start, end, "parquet")


def ingest_daily_csv(spark: SparkSession, folder: str, target: str) -> None:
    """Raw ``AIS_YYYY_MM_DD.csv`` files to one Parquet partition per date.

    A CSV split holds one date, so tasks write straight to their partition without a shuffle.
    """
    named = list_days(spark, folder).filter((F.col("format") == "csv") & F.col("path").rlike(r"/AIS_[^/]*$"))
    dated = read_pings(spark, [("csv", r["path"]) for r in named.orderBy("path").collect()])
    (
        dated.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("file_date")
        .parquet(target)
    )


def load_full_range(spark: SparkSession, folder: str, start: str | date, end: str | date) -> DataFrame:
    """All raw daily files of a range, by ping time, without repeats."""
    return dedup_pings(date_range(scan_days(spark, folder, start, end), start, end))
