"""Stored tables: day caches, the consolidated table, anomalies, statistics, sequences."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmtrace.operators.cleaning import date_range, dedup_pings, filter_vessel_types
from helmtrace.schemas import ANOMALY_SCHEMA


STAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def params_folder(root: str, params: dict) -> str:
    """Folder named by a hash of the settings a stored table depends on."""
    text = json.dumps(params, sort_keys=True, default=str)
    return f"{root.rstrip('/')}/{hashlib.md5(text.encode()).hexdigest()}"


def _file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path itself."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a stored table is there: its folder holds something. No file is opened."""
    fs, at = _file_system(spark, path)
    return bool(fs.exists(at)) and (bool(fs.getFileStatus(at).isFile()) or len(fs.listStatus(at)) > 0)


def source_state(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int, int]]:
    """Path, size and modification time of every file below ``paths``: what a cache made from them depends on."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    rows = files.select("path", "length", F.unix_micros("modificationTime").alias("time")).orderBy("path")
    digest = rows.agg(F.count("*").alias("n"), F.sum("length").alias("size"), F.bit_xor(F.xxhash64("path", "length", "time")).alias("mix"))
    return [tuple(r) for r in digest.collect()]


def write_day_cache(clean: DataFrame, root: str, params: dict, sources: Sequence[str] = ()) -> str:
    """Cleaned days under a hash of the settings and of the state of their source files.

    Dates written again replace only themselves. Sources that changed since give another folder, so a stale
    table is never served; the state is one row, whatever the number of files.
    """
    folder = params_folder(root, _cache_key(clean.sparkSession, params, sources))
    (
        clean.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("file_date")
        .parquet(folder)
    )
    return folder


def _cache_key(spark: SparkSession, params: dict, sources: Sequence[str]) -> dict:
    return {**params, "_sources": source_state(spark, sources)} if sources else params


def read_day_cache(spark: SparkSession, root: str, params: dict, sources: Sequence[str] = ()) -> DataFrame | None:
    folder = params_folder(root, _cache_key(spark, params, sources))
    return spark.read.parquet(folder) if exists(spark, folder) else None


def load_cached_range(
    table: DataFrame, start: str | date, end: str | date, types: Sequence[int] | None = None
) -> DataFrame:
    """Stored pings by date range and vessel types, without repeats; both filters push down."""
    return dedup_pings(filter_vessel_types(date_range(table, start, end), types or []))


def cache_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Number of files and megabytes; only metadata is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    data = files.filter(F.col("path").endswith(".parquet"))
    return data.agg(
        F.count(F.lit(1)).alias("files"), (F.coalesce(F.sum("length"), F.lit(0)) / (1024 * 1024)).alias("megabytes")
    )


def clear_cache(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None) -> int:
    """Deletes a stored table, or its date partitions in a range; returns how many were deleted."""
    fs, top = _file_system(spark, folder)
    if not fs.exists(top):
        return 0
    if start is None and end is None:
        return int(fs.delete(top, True))
    gone = 0
    for status in fs.listStatus(top):
        name = status.getPath().getName()
        day = name.removeprefix("file_date=")
        if name != day and (start or "") <= day <= (end or "9999"):
            gone += int(fs.delete(status.getPath(), True))
    return gone


def consolidate(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables without repeats of (vessel, time); the stored row wins."""
    return stored.unionByName(new_rows(stored, new), allowMissingColumns=True)


def new_rows(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new``, repeats merged, whose (vessel, time) is not stored yet."""
    keys = ["MMSI", "BaseDateTime"]
    return dedup_pings(new).join(stored.select(*keys), keys, "left_anti")


def append_consolidated(spark: SparkSession, new: DataFrame, path: str) -> None:
    """Adds the unseen rows to the stored table; what is there is never rewritten.

    A repeat has the same time, so only stored partitions around the new rows' file dates and times are read for
    the comparison (one day either way): their list, one value per calendar day, prunes the stored side.
    Stored rows without a date are always compared.
    """
    rows = dedup_pings(new)
    if exists(spark, path):
        around = [F.date_add(F.coalesce(d, F.to_date("BaseDateTime")), n) for d in (F.col("file_date"), F.to_date("BaseDateTime")) for n in (-1, 0, 1)]
        days = [r[0] for r in new.select(F.explode(F.array_distinct(F.array(*around))).alias("d")).distinct().collect() if r[0]]
        old = spark.read.parquet(path)
        rows = new_rows(old.filter(F.col("file_date").isin(days) | F.col("file_date").isNull()), new)
    rows.write.mode("append").partitionBy("file_date").parquet(path)


def union_days(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# --- anomalies and reports ----------------------------------------------------------------


def write_anomalies(anomalies: DataFrame, path: str, form: str = "csv") -> None:
    writer = anomalies.write.mode("overwrite")
    if form == "csv":
        writer.option("header", "true").option("timestampFormat", STAMP_FORMAT).csv(path)
    else:
        writer.parquet(path)


def load_anomalies(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    """The anomaly table, or an empty one in the same layout where nothing is stored."""
    if not exists(spark, path):
        return spark.createDataFrame([], ANOMALY_SCHEMA)
    reader = spark.read.schema(ANOMALY_SCHEMA)
    if form == "csv":
        return (
            reader.option("header", "true").option("timestampFormat", STAMP_FORMAT).csv(path)
        )
    return reader.parquet(path)


def export_dataset(pings: DataFrame, path: str, info: dict[str, str] | None = None) -> None:
    """All pings as CSV part files; an information table when there are none."""
    if pings.isEmpty():
        rows = [*(info or {}).items(), ("Status", "No data found for the date range")]
        table = pings.sparkSession.createDataFrame(rows, "Parameter string, Value string")
    else:
        table = pings
    table.write.mode("overwrite").option("header", "true").option("timestampFormat", STAMP_FORMAT).csv(path)


def write_statistics(tables: dict[str, DataFrame], folder: str, anomalies: DataFrame | None = None) -> None:
    """Each table as CSV in its own folder; anomalies in one folder per date."""
    for name, table in tables.items():
        table.write.mode("overwrite").option("header", "true").csv(f"{folder}/{name}")
    if anomalies is not None:
        dated = anomalies.withColumn("day", F.coalesce("Date", F.to_date("BaseDateTime")))
        writer = dated.write.mode("overwrite").partitionBy("day").option("header", "true")
        writer.option("timestampFormat", STAMP_FORMAT).csv(f"{folder}/anomalies")


def save_sequences(sequences: DataFrame, root: str, params: dict) -> str:
    folder = params_folder(root, params)
    sequences.write.mode("overwrite").parquet(folder)
    return folder


def load_sequences(spark: SparkSession, root: str, params: dict) -> DataFrame | None:
    folder = params_folder(root, params)
    return spark.read.parquet(folder) if exists(spark, folder) else None
