"""A membership index of a stored ping table: which of new rows may be there already.

The index holds, per stored date and calendar day of the keys, a Bloom filter over (vessel, time). A filter is
cut into blocks of 32,768 bits: a key sets ``PROBES`` bits of one block. Blocks are the rows of the index, so filters are
built, merged and asked by grouping and joining, and no task or driver holds a whole one.

A filter has no false negatives, so keys that it does not know are new without a look at the stored table. The others are
compared exactly; a false positive costs one comparison and changes no result. Rows without a vessel or a
time equal no stored row and are always new, as in ``append_consolidated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helmtrace.operators.cleaning import dedup_pings
from helmtrace.session import stage
from helmtrace.sources.stores import exists

KEYS = ["MMSI", "BaseDateTime"]
#: Fixed value: the bits of one bitmap of Spark's bitmap functions.
BLOCK_BITS = 32_768
#: Bits set by a key, and bits of a filter per expected key: one false positive in about 80 keys.
PROBES, BITS_PER_KEY = 4, 10
#: Keys that a filter is laid out for. More keys raise the share of false positives, nothing else.
KEYS_PER_DATE = 10_000_000


def _keyed(rows: DataFrame, keys_per_date: int) -> DataFrame:
    """Date, day and keys of rows that have both keys, with the block and the hash that gives the bits."""
    blocks = max(1, -(-keys_per_date * BITS_PER_KEY // BLOCK_BITS))
    mixed = F.xxhash64(F.col("MMSI").cast("long"), F.unix_micros("BaseDateTime"))
    return rows.filter(F.col("MMSI").isNotNull() & F.col("BaseDateTime").isNotNull()).select(
        "file_date",
        F.to_date("BaseDateTime").alias("day"),
        *KEYS,
        F.pmod(mixed, F.lit(blocks)).cast("int").alias("block"),
        F.xxhash64(mixed, F.lit(1)).alias("_bits"),
    )


def _positions() -> list[Column]:
    """The bits of a key in its block: fifteen bits of the hash each."""
    return [F.shiftrightunsigned("_bits", 15 * i).bitwiseAND(BLOCK_BITS - 1) for i in range(PROBES)]


def _is_set(bitmap: Column, position: Column) -> Column:
    """Whether a bit of a bitmap is set; bits count from the low end of each byte."""
    byte = F.conv(F.hex(F.substring(bitmap, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.get(F.array(*[byte.bitwiseAND(1 << i) for i in range(8)]), (position % 8).cast("int")) > 0


def filters(rows: DataFrame, keys_per_date: int = KEYS_PER_DATE) -> DataFrame:
    """The filters of ``rows``: file_date, day, block, bitmap. Bits are gathered on the map side."""
    bits = _keyed(rows, keys_per_date).select("file_date", "day", "block", F.explode(F.array(*_positions())).alias("bit"))
    return bits.groupBy("file_date", "day", "block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def merge_filters(left: DataFrame, right: DataFrame) -> DataFrame:
    """The filters that know the keys of both sides; both need the same ``keys_per_date``."""
    return left.unionByName(right).groupBy("file_date", "day", "block").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def possible_repeats(rows: DataFrame, index: DataFrame, keys_per_date: int = KEYS_PER_DATE) -> DataFrame:
    """Keys of ``rows`` that may be stored, each with the stored dates to look in (``stored_date``)."""
    asked = _keyed(rows, keys_per_date).drop("file_date").distinct()
    known = index.withColumnRenamed("file_date", "stored_date")
    met = asked.join(known, ["day", "block"])
    for position in _positions():
        met = met.filter(_is_set(F.col("bitmap"), position))
    return met.select(*KEYS, "stored_date")


def _write_index(blocks: DataFrame, path: str) -> None:
    # Replaces the dates written and no others, whatever the session's setting.
    blocks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_date").parquet(path)


def build_index(spark: SparkSession, table_path: str, index_path: str, keys_per_date: int = KEYS_PER_DATE) -> None:
    """Indexes a table that is stored already, anew."""
    _write_index(filters(spark.read.parquet(table_path), keys_per_date), index_path)


def repeats_of(stored: DataFrame, candidates: DataFrame) -> DataFrame:
    """Keys of ``candidates`` that are stored. Only the stored dates they name are read; a row without a date has its own."""
    dates = [r[0] for r in candidates.select("stored_date").distinct().collect()]
    named = F.col("file_date").isin([d for d in dates if d is not None])
    read = stored.filter(named | F.col("file_date").isNull() if None in dates else named)
    return candidates.select(*KEYS).distinct().join(read.select(*KEYS), KEYS, "left_semi")


def append_indexed(spark: SparkSession, new: DataFrame, path: str, index_path: str, keys_per_date: int = KEYS_PER_DATE) -> None:
    """Adds the rows of ``new`` whose (vessel, time) is not stored yet; the stored row wins.

    The same result as ``append_consolidated``, but only keys that the index knows meet the stored table, and a stored
    row is found under any date. Filters are written before the rows: a run that dies in between leaves keys in the
    index that are not stored, which are false positives, and can be repeated. A table without an index gets one first.
    All appends have to go by the index, with the same ``keys_per_date``, one writer at a time.
    """
    rows = stage(dedup_pings(new), "appended")
    fresh = rows
    had_index = exists(spark, index_path)
    if exists(spark, path):
        if not had_index:
            build_index(spark, path, index_path, keys_per_date)
            had_index = True
        candidates = stage(possible_repeats(rows, spark.read.parquet(index_path), keys_per_date), "candidates")
        fresh = rows.join(repeats_of(spark.read.parquet(path), candidates), KEYS, "left_anti").select(*rows.columns)
    blocks = filters(rows, keys_per_date)
    if had_index:
        touched = rows.select("file_date").distinct()
        old = spark.read.parquet(index_path)
        same = old["file_date"].eqNullSafe(touched["file_date"])
        blocks = merge_filters(old.join(touched, same, "left_semi"), blocks)
    # The rows to add are settled before the index changes under them.
    fresh = stage(fresh, "fresh")
    _write_index(blocks, index_path)
    fresh.write.mode("append").partitionBy("file_date").parquet(path)
