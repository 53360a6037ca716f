"""Ping tables derived from the ``events`` test table, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmtrace.schemas import Params

# Zones around the positions of the test pings.
ZONES = [
    {"name": "Box", "geometry_type": "rectangle", "lat_min": 24.0, "lat_max": 24.3, "lon_min": -83.1, "lon_max": -82.6},
    {"name": "Ring", "geometry_type": "circle", "center_lat": 24.5, "center_lon": -82.5, "radius_meters": 900.0},
    {
        "name": "Wedge",
        "geometry_type": "polygon",
        "coordinates": "[[24.74,-82.26],[24.7581,-82.24],[24.74,-82.24]]",
    },
    {
        "name": "Cable",
        "geometry_type": "polyline",
        "coordinates": '[{"lat":24.99,"lon":-82.01},{"lat":25.02,"lon":-81.98}]',
        "tolerance_meters": 150.0,
    },
]

# The default 24 h cannot be reached inside one calendar day, so the checks use 12 h.
CHECK_PARAMS = Params(loitering_hours=12.0, loitering_min_records=3)


def sparse_or_dense(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    v = F.col("user_id") % 10 if dense else F.col("user_id")
    e = F.col("event_id")
    cog = (e * 37) % 360
    kinds = F.array(*[F.lit(k) for k in (30, 31, 52, 60, 70, 71, 80, 90)])
    ts = F.col("ts").cast("timestamp")
    return events.select(
        (v + 366000000).alias("MMSI"),
        F.concat(F.when(e % 101 == 0, "ALIAS ").otherwise("VESSEL "), v.cast("string")).alias("VesselName"),
        F.get(kinds, (v % 8).cast("int")).alias("VesselType"),
        # Whole ten-thousandths over 10,000: the double nearest to the decimal the SQL computes.
        ((v % 5 * 2500 + e % 97 + F.when(e % 10 == 0, 320000).otherwise(240000)) / 10000.0).alias("LAT"),
        ((v % 5 * 2500 + e % 89 - 830000) / 10000.0).alias("LON"),
        (F.col("value") % 30).alias("SOG"),
        cog.cast("double").alias("COG"),
        F.when(e % 23 != 0, (cog + F.when(e % 11 == 0, 90).otherwise(e % 30)) % 360).cast("double").alias("Heading"),
        ts.alias("BaseDateTime"),
        F.to_date(ts).alias("file_date"),
        e.alias("event_id"),
    )


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_or_dense(spark, sf_dir).drop("event_id")


def dense_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_or_dense(spark, sf_dir, dense=True).drop("event_id")


def raw_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings with broken rows: odd positions, speeds, types and times as text; repeated rows."""
    rows = sparse_or_dense(spark, sf_dir)
    e = F.col("event_id")
    extra = rows.filter(e % 9 == 0).withColumn("LAT", F.col("LAT") + 0.5)
    rows = rows.unionByName(extra)
    return rows.select(
        "MMSI",
        F.when(e % 31 != 0, F.col("VesselName")).alias("VesselName"),
        F.when(e % 17 == 0, F.lit(None)).when(e % 19 == 0, 0).otherwise(F.col("VesselType")).cast("int").alias("VesselType"),
        F.when(e % 13 == 0, F.lit(None)).when(e % 14 == 0, 95.0).when(e % 15 == 0, 0.0).otherwise(F.col("LAT")).alias("LAT"),
        F.when(e % 15 == 0, 0.0).otherwise(F.col("LON")).alias("LON"),
        F.when(e % 7 == 0, F.lit(None)).when(e % 16 == 0, 150.0).otherwise(F.col("SOG")).alias("SOG"),
        F.when(e % 21 == 0, 400.0).otherwise(F.col("COG")).alias("COG"),
        "Heading",
        F.when(e % 29 != 0, F.col("BaseDateTime")).alias("BaseDateTime"),
        "file_date",
        F.when(e % 3 == 0, F.col("SOG") * 4).alias("Length"),
    )


PINGS_SQL = """
SELECT 366000000 + v AS MMSI,
  CASE WHEN event_id % 101 = 0 THEN 'ALIAS ' ELSE 'VESSEL ' END || v AS VesselName,
  CAST(CASE v % 8 WHEN 0 THEN 30 WHEN 1 THEN 31 WHEN 2 THEN 52 WHEN 3 THEN 60
             WHEN 4 THEN 70 WHEN 5 THEN 71 WHEN 6 THEN 80 ELSE 90 END AS BIGINT) AS VesselType,
  CAST(24.0 + (v % 5) * 0.25 + (event_id % 97) * 0.0001
       + CASE WHEN event_id % 10 = 0 THEN 8.0 ELSE 0.0 END AS DOUBLE) AS LAT,
  CAST(-83.0 + (v % 5) * 0.25 + (event_id % 89) * 0.0001 AS DOUBLE) AS LON,
  value % 30 AS SOG, CAST((event_id * 37) % 360 AS DOUBLE) AS COG,
  CAST(CASE WHEN event_id % 23 = 0 THEN NULL
       ELSE ((event_id * 37) % 360 + CASE WHEN event_id % 11 = 0 THEN 90 ELSE event_id % 30 END) % 360
       END AS DOUBLE) AS Heading,
  ts AS BaseDateTime, CAST(ts AS DATE) AS file_date, event_id
FROM (SELECT *, {v} AS v FROM events)
"""

RAW_SQL = """
SELECT MMSI, CASE WHEN event_id % 31 <> 0 THEN VesselName END AS VesselName,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 0 ELSE VesselType END AS VesselType,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 14 = 0 THEN 95.0 WHEN event_id % 15 = 0 THEN 0.0 ELSE LAT END AS LAT,
  CASE WHEN event_id % 15 = 0 THEN 0.0 ELSE LON END AS LON,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 16 = 0 THEN 150.0 ELSE SOG END AS SOG,
  CASE WHEN event_id % 21 = 0 THEN 400.0 ELSE COG END AS COG,
  Heading, CASE WHEN event_id % 29 <> 0 THEN BaseDateTime END AS BaseDateTime, file_date,
  CASE WHEN event_id % 3 = 0 THEN SOG * 4 END AS Length
FROM (SELECT * FROM pings UNION ALL SELECT * REPLACE (LAT + 0.5 AS LAT) FROM pings WHERE event_id % 9 = 0)
"""

