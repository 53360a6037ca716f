from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helmtrace.operators import cleaning as C
from helmtrace.operators import vessels as V
from helmtrace.plans.jobs import JOBS, run_job
from helmtrace.plans.detection import all_anomalies
from helmtrace.schemas import PING_COLUMNS
from helmtrace.sources import daily, stores
from helmtrace.streaming.ingest import ingest_new_files
from tests.helpers import ping, table

HEADER = ",".join(PING_COLUMNS)


def csv(folder: Path, name: str, *rows: str, header: str = HEADER) -> None:
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([header, *rows]) + "\n")


def test_scan_skips_bad_files_and_values(spark, tmp_path, capsys):
    csv(tmp_path, "ais-2024-01-01.csv", "123456789.0,A,70,1.5,2.5,3.0,4.0,5.0,2024-01-01 01:02:03", "bad,B,x,y,,9,,,never")
    csv(tmp_path, "2024-01-02.csv", "1,A,70,1.5,2.5,3.0,4.0,5.0,2024-01-02 00:00:00")
    csv(tmp_path, "ais-2024-01-03.csv", "1,A", header="MMSI,VesselName")
    csv(tmp_path, "ais-2024-02-01.csv", "1,A,70,1.5,2.5,3.0,4.0,5.0,2024-02-01 00:00:00")
    csv(tmp_path, "notes.csv", "x", header="x")
    got = daily.scan_days(spark, str(tmp_path), "2024-01-01", "2024-01-31").orderBy("file_date", F.desc("MMSI")).collect()
    assert [(r.MMSI, str(r.file_date)) for r in got] == [(123456789, "2024-01-01"), (None, "2024-01-01"), (1, "2024-01-02")]
    assert got[1].LAT is None and got[1].VesselType is None and got[1].BaseDateTime is None and got[1].SOG == 9.0
    assert "ais-2024-01-03.csv" in capsys.readouterr().out


def test_stream_takes_each_file_once(spark, tmp_path):
    source, target, log = tmp_path / "in", tmp_path / "out", tmp_path / "log"
    csv(source, "AIS_2024_01_01.csv", "1,A,70,1.5,2.5,3.0,4.0,5.0,2024-01-01 00:00:00")
    for _ in range(2):
        ingest_new_files(spark, str(source), str(target), str(log)).awaitTermination()
    assert spark.read.parquet(str(target)).count() == 1
    csv(source, "AIS_2024_01_02.csv", "1,A,70,1.5,2.5,3.0,4.0,5.0,2024-01-02 00:00:00")
    ingest_new_files(spark, str(source), str(target), str(log)).awaitTermination()
    assert [str(r[0]) for r in spark.read.parquet(str(target)).select("file_date").orderBy("file_date").collect()] == ["2024-01-01", "2024-01-02"]


def test_consolidated_table_keeps_stored_rows(spark, tmp_path):
    path = str(tmp_path / "all")
    stores.append_consolidated(spark, table(spark, [ping(1, "2024-01-01", lat=1.0), ping(1, "2024-01-01", lat=2.0)]), path)
    more = table(spark, [ping(1, "2024-01-01", lat=9.0), ping(2, "2024-01-02", lat=3.0)])
    for _ in range(2):
        stores.append_consolidated(spark, more, path)
    assert sorted((r.MMSI, r.LAT) for r in spark.read.parquet(path).collect()) == [(1, 1.0), (2, 3.0)]


def test_caches_by_settings(spark, tmp_path):
    root, rows = str(tmp_path), table(spark, [ping(1, "2024-01-01"), ping(1, "2024-01-02")])
    folder = stores.write_day_cache(rows, root, {"types": [70]})
    assert stores.read_day_cache(spark, root, {"types": [70]}).count() == 2
    assert stores.read_day_cache(spark, root, {"types": [80]}) is None
    stores.write_day_cache(table(spark, [ping(5, "2024-01-02")]), root, {"types": [70]})
    assert sorted(r.MMSI for r in stores.read_day_cache(spark, root, {"types": [70]}).collect()) == [1, 5]
    assert stores.clear_cache(spark, folder, "2024-01-02", "2024-01-02") == 1
    assert stores.read_day_cache(spark, root, {"types": [70]}).count() == 1
    assert stores.clear_cache(spark, folder) == 1 and stores.clear_cache(spark, folder) == 0


def test_anomalies_round_trip_and_empty(spark, tmp_path):
    rows = [ping(1, "2024-01-01 12:00:00", sog=12.0, cog=0.0, heading=90.0), ping(1, "2024-01-02 12:00:00", sog=12.0, cog=0.0, heading=90.0)]
    found = all_anomalies(table(spark, rows))
    for form in ("csv", "parquet"):
        stores.write_anomalies(found, str(tmp_path / form), form)
        back = stores.load_anomalies(spark, str(tmp_path / form), form)
        assert back.exceptAll(found).count() == 0 and back.count() == found.count() == 1
    assert stores.load_anomalies(spark, str(tmp_path / "none")).count() == 0
    stores.export_dataset(table(spark, []), str(tmp_path / "export"), {"Start Date": "2024-01-01"})
    assert spark.read.option("header", True).csv(str(tmp_path / "export")).count() == 2


def test_type_pick_falls_back_when_empty(spark):
    rows = [ping(1, "2024-01-01 12:00:00"), ping(1, "2024-01-02 12:00:00", sog=12.0, cog=0.0, heading=90.0)]
    pings = table(spark, rows)
    found = all_anomalies(pings)
    assert V.anomalies_of_types(pings, found, [30], ["Loitering"]).count() == 1
    assert V.anomalies_of_types(pings, found, [70], ["Course"]).count() == 1


def test_vessel_with_two_types_counts_under_both(spark):
    rows = [ping(1, "2024-01-01 12:00:00", kind=30), ping(1, "2024-01-02 12:00:00", sog=12.0, cog=0.0, heading=90.0)]
    pings = table(spark, rows)
    cross = V.type_anomaly_crosstab(pings, all_anomalies(pings)).collect()
    assert sorted((r.VesselType, r.Course) for r in cross) == [(30, 1), (70, 1)]


def test_all_jobs_run(spark):
    rows = [ping(m, f"2024-01-0{d} 12:00:00", sog=12.0 + m, cog=0.0, heading=90.0) for m in range(1, 8) for d in (1, 2, 3)]
    pings = table(spark, rows)
    found = all_anomalies(pings)
    for name in JOBS:
        for part in run_job(name, pings, found).values():
            assert part.count() > 0, name


@pytest.mark.parametrize("start, end, ok", [("2024-01-01", "2024-12-31", True), ("2024-01-01", "2025-01-02", True), ("2024-01-02", "2024-01-01", False), ("x", "2024-01-01", False)])
def test_date_range_check(start, end, ok):
    assert C.validate_date_range(start, end)[0] is ok
