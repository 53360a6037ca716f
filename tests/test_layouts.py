"""Daily files as a data source: partitions, pushed ranges, reports of refused files, nothing opened on the driver."""

from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringContains

from helmtrace.schemas import PING_COLUMNS
from helmtrace.sources import daily, layouts
from tests.helpers import ping, table
from tests.test_sources import csv

ROW = "1,A,70,1.5,2.5,3.0,4.0,5.0,2024-01-0{} 01:02:03"


@pytest.fixture
def folder(spark, tmp_path):
    csv(tmp_path, "ais-2024-01-01.csv", ROW.format(1))
    csv(tmp_path, "2024-01-02.csv", "2024-01-02 01:02:03,5.0,4.0,3.0,2.5,1.5,70,B,2", header="\ufeff" + ",".join(PING_COLUMNS[::-1]))
    (tmp_path / "more").mkdir()
    csv(tmp_path / "more", "ais-2024-01-02.csv", '3,"C, the third",70,1.5,2.5,3.0,4.0,5.0,2024-01-02 01:02:03,9', header=",".join([*PING_COLUMNS, "Length"]))
    csv(tmp_path, "ais-2024-01-03.csv", "1,A", header="MMSI,VesselName")
    (tmp_path / "ais-2024-01-04.csv").write_text("")
    (tmp_path / "ais-2024-01-05.parquet").write_text("no table")
    csv(tmp_path, "ais-2024-13-01.csv", ROW.format(1))
    csv(tmp_path, "notes.csv", "x", header="x")
    table(spark, [ping(6, "2024-01-06 00:00:00")]).drop("file_date").coalesce(1).write.parquet(str(tmp_path / "AIS_2024_01_06.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_every_file_is_reported_once(spark, folder, scheme):
    rows = layouts.file_report(spark, scheme + folder, "2024-01-01", "2024-12-31").collect()
    found = sorted((str(r.file_date), r.format, len(r.missing), r.problem is not None) for r in rows)
    assert found == [
        ("2024-01-01", "csv", 0, False), ("2024-01-02", "csv", 0, False), ("2024-01-02", "csv", 0, False), ("2024-01-03", "csv", 7, False),
        ("2024-01-04", "csv", 0, True), ("2024-01-05", "parquet", 0, True), ("2024-01-06", "parquet", 0, False),
    ]
    assert all(r.path.startswith(scheme + folder + "/") and r.bytes >= 0 for r in rows)


def test_refused_files_are_rows_and_the_others_are_read(spark, folder):
    report = layouts.file_report(spark, folder, "2024-01-01", "2024-12-31")
    reasons = {str(r.file_date): r.reason for r in layouts.refused(report).collect()}
    assert set(reasons) == {"2024-01-03", "2024-01-04", "2024-01-05"}
    assert reasons["2024-01-03"].startswith("no VesselType, LAT") and reasons["2024-01-04"] == "ValueError: no header"
    got = daily.read_reported(spark, report).orderBy("MMSI")
    assert [(r.MMSI, r.VesselName, str(r.file_date), r.LAT, r.Length) for r in got.collect()] == [
        (1, "A", "2024-01-01", 1.5, None), (2, "B", "2024-01-02", 1.5, None), (3, "C, the third", "2024-01-02", 1.5, 9.0), (6, "A", "2024-01-06", 10.0, None),
    ]


def test_nothing_is_opened_on_the_driver(spark, folder, monkeypatch):
    def forbidden(*_):
        raise AssertionError("a file was opened on the driver")

    monkeypatch.setattr(daily, "_csv_header", forbidden)
    monkeypatch.setattr(daily, "file_layouts", forbidden)
    monkeypatch.setattr(layouts, "csv_layout", forbidden)
    monkeypatch.setattr(layouts, "parquet_layout", forbidden)
    got = daily.scan_days(spark, folder, "2024-01-01", "2024-01-02")
    assert sorted(r.MMSI for r in got.collect()) == [1, 2, 3]
    assert [r.MMSI for r in daily.read_history(spark, folder, "2024-01-06", "2024-01-06").collect()] == [6]


def test_a_range_of_dates_makes_fewer_partitions(spark, folder):
    reader = layouts.LayoutReader({"path": folder, "filesPerPartition": "1"})
    left = list(reader.pushFilters([GreaterThanOrEqual(("file_date",), date(2024, 1, 2)), LessThan(("file_date",), date(2024, 1, 4)), StringContains(("path",), "ais")]))
    assert [type(f) for f in left] == [StringContains] and len(reader.partitions()) == 3
    reader = layouts.LayoutReader({"path": folder, "filesPerPartition": "1"})
    assert list(reader.pushFilters([In(("file_date",), (date(2024, 1, 1), date(2024, 1, 6))), EqualTo(("file_date",), date(2024, 1, 6))])) == []
    assert len(reader.partitions()) == 1
    one = layouts.file_report(spark, folder, "2024-01-06", "2024-01-06")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 1


def test_an_empty_range_and_a_store_that_tasks_cannot_open(spark, folder):
    assert layouts.file_report(spark, folder, "2030-01-01", "2030-12-31").collect() == []
    with pytest.raises(FileNotFoundError):
        daily.scan_days(spark, folder, "2030-01-01", "2030-12-31")
    assert not layouts.reachable("viewfs://store/in") and layouts.reachable("s3a://bucket/ais") and layouts.reachable("/data")
    files = daily.list_days(spark, folder).select("path").collect()
    mine = layouts.file_report(spark, f"file:{folder}", "2000-01-01", "2100-01-01").select("path").collect()
    # Spark's own listing leaves empty files out.
    assert {r.path for r in mine} == {r.path for r in files} | {f"file:{folder}/ais-2024-01-04.csv"}
    assert layouts.usable(layouts.file_report(spark, folder, "2024-01-02", "2024-01-02")).agg(F.count("*")).first()[0] == 2
