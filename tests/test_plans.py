"""Properties of the physical plans."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helmtrace.checks.fixtures import CHECK_PARAMS, ZONES
from helmtrace.operators import anomalies as A
from helmtrace.operators import cleaning as C
from helmtrace.plans.detection import all_anomalies, hourly_summary
from tests.helpers import ping, table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pings") / "t")
    rows = [ping(m, f"2024-01-0{d} 0{h}:00:00") for m in range(1, 5) for d in (1, 2) for h in range(9)]
    table(spark, rows).write.partitionBy("file_date").parquet(path)
    assert Path(path).exists()
    return spark.read.parquet(path)


def test_cleaner_and_range_reach_the_scan(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(C.date_range(C.clean_positions(stored), "2024-01-02", "2024-01-02").select("MMSI"))
    assert "PushedFilters: [IsNotNull(" in text and "LessThanOrEqual(SOG,102.0)" in text
    assert "PartitionFilters: [isnotnull(file_date" in text
    assert "VesselName" not in text.split("ReadSchema")[1]


def test_no_cross_products_in_detection(stored):
    text = plan(all_anomalies(stored, ZONES, CHECK_PARAMS))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "Pandas" not in text


def test_rank_limits_apply_before_the_shuffle(stored):
    assert plan(A.cap_per_vessel(stored.withColumn("Date", F.to_date("BaseDateTime")).withColumn("AnomalyType", F.lit("Speed")), 5)).count("WindowGroupLimit") == 2
    assert "WindowGroupLimit" in plan(C.recent_window(stored))


def test_detectors_share_one_summary_that_hashes(spark, stored):
    summary = plan(hourly_summary(stored, F.col("SOG") <= 102))
    assert "SortAggregate" not in summary and "ObjectHashAggregate" not in summary and summary.count("HashAggregate") == 2
    final = all_anomalies(stored, ZONES, CHECK_PARAMS)
    final.collect()
    text = final._jdf.queryExecution().executedPlan().toString()
    ended = text.split("Initial Plan")[0]
    # Course and zones read the pings again; all else comes from stored tables.
    reads = [line for line in ended.splitlines() if "FileScan" in line and "VesselName" in line and "pings" in line]
    assert len(reads) <= 2


def test_records_meet_their_rows_in_one_join_whatever_their_kind(stored):
    text = plan(all_anomalies(stored, ZONES, CHECK_PARAMS))
    # One join for the kinds that need a single row, and two for speed, which needs the row of the day before as well.
    scans = [line for line in text.splitlines() if "FileScan" in line and ("low#" in line or "high#" in line)]
    assert len(scans) == 3
    # The names of a vessel-day are gathered once and stored, not again with the result.
    assert "collect_list(struct(since" not in text
