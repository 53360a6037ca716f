"""Helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helmtrace.session import stage

# The white space that separates words (U+0020 and U+0009 to U+000D).
WHITE = " \t\n\x0b\f\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, lost executors cost nothing.

    The folder lies below ``spark.checkpoint.dir``, which all executors reach, and is deleted when the application ends.
    """
    return stage(df, name)


def drop_stored(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a table written by ``stored`` once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names: an operator's own columns replace columns of the same name."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def whole(text: str | Column) -> Column:
    """The text of a row, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
