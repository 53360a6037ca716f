"""Daily files as a file stream: each new file is ingested once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from helmtrace.functions.times import date_from_name
from helmtrace.schemas import PING_COLUMNS
from helmtrace.sources.daily import normalise


def ingest_new_files(
    spark: SparkSession, folder: str, target: str, checkpoint: str, columns: list[str] | None = None
) -> StreamingQuery:
    """Takes up the daily CSV files that arrived since the last run, then stops.

    The checkpoint must lie in storage all executors share; it is what makes a file count once.
    """
    layout = T.StructType([T.StructField(c, T.StringType()) for c in columns or PING_COLUMNS])
    raw = (
        spark.readStream.schema(layout)
        .option("header", "true")
        .option("enforceSchema", "false")
        .option("pathGlobFilter", "*.csv")
        .csv(folder)
    )
    dated = normalise(raw, date_from_name("_metadata.file_path")).filter(F.col("file_date").isNotNull())
    return (
        dated.writeStream.format("parquet")
        .partitionBy("file_date")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
