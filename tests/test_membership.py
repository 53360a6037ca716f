from datetime import date

import pytest

from helmtrace.sources import membership as M
from helmtrace.sources import stores
from tests.helpers import ping, table


def stored_keys(spark, path):
    return sorted((r.MMSI, str(r.BaseDateTime), r.LAT) for r in spark.read.parquet(path).collect())


def rows_of(spark, first, last, lat, day="2024-01-01", file_day=None):
    return table(spark, [ping(m, f"{day} {m % 24:02d}:00:00", lat=lat, day=file_day) for m in range(first, last)])


@pytest.mark.parametrize("keys_per_date", [1, 1_000_000])
def test_overlapping_appends_equal_the_plain_ones(spark, tmp_path, keys_per_date):
    path, index, plain = (str(tmp_path / n) for n in ("all", "index", "plain"))
    parts = [
        rows_of(spark, 0, 300, 1.0),
        rows_of(spark, 200, 500, 2.0),
        rows_of(spark, 0, 50, 3.0, "2024-01-02").unionByName(rows_of(spark, 400, 520, 3.0)),
        rows_of(spark, 400, 520, 4.0),
        table(spark, []),
    ]
    for part in parts:
        M.append_indexed(spark, part, path, index, keys_per_date)
        stores.append_consolidated(spark, part, plain)
    assert stored_keys(spark, path) == stored_keys(spark, plain)
    assert len(stored_keys(spark, path)) == 570
    # One filter per stored date and day of its keys, whatever the number of appends.
    blocks = spark.read.parquet(index)
    assert blocks.count() == blocks.select("file_date", "day", "block").distinct().count()
    assert sorted({str(r.file_date) for r in blocks.collect()}) == ["2024-01-01", "2024-01-02"]


def test_no_stored_key_is_unknown_and_false_positives_are_few(spark):
    stored, others = rows_of(spark, 0, 20_000, 1.0), rows_of(spark, 20_000, 40_000, 1.0)
    index = M.filters(stored, 20_000).cache()
    assert M.possible_repeats(stored, index, 20_000).distinct().count() == 20_000
    assert M.possible_repeats(others, index, 20_000).count() < 20_000 * 0.03
    # A filter far too small knows every key, and the comparison still tells them apart.
    full = M.filters(stored, 1)
    candidates = M.possible_repeats(others, full, 1)
    assert candidates.count() > 10_000
    assert M.repeats_of(stored, candidates).count() == 0


def test_repeats_under_any_date_and_rows_without_keys(spark, tmp_path):
    path, index = str(tmp_path / "all"), str(tmp_path / "index")
    late = date(2024, 3, 1)
    odd = [ping(None, "2024-01-01", lat=1.0), (8, "A", 70, 1.0, 2.0, 5.0, None, None, None, late)]
    M.append_indexed(spark, table(spark, [ping(1, "2024-01-01", lat=1.0, day=late), *odd]), path, index)
    M.append_indexed(spark, table(spark, [ping(1, "2024-01-01", lat=2.0), ping(2, "2024-01-01", lat=2.0), *odd]), path, index)
    got = [(r.MMSI, r.LAT) for r in spark.read.parquet(path).collect()]
    assert sorted(got, key=str) == sorted([(1, 1.0), (2, 2.0), (None, 1.0), (None, 1.0), (8, 1.0), (8, 1.0)], key=str)


def test_a_run_that_dies_between_index_and_rows_can_be_repeated(spark, tmp_path):
    path, index = str(tmp_path / "all"), str(tmp_path / "index")
    M.append_indexed(spark, rows_of(spark, 0, 10, 1.0), path, index, 1000)
    more = rows_of(spark, 5, 20, 2.0)
    M._write_index(M.merge_filters(spark.read.parquet(index), M.filters(more, 1000)), index)
    M.append_indexed(spark, more, path, index, 1000)
    assert [r[0] for r in stored_keys(spark, path)] == list(range(20))


def test_a_table_without_an_index_gets_one(spark, tmp_path):
    path, index = str(tmp_path / "all"), str(tmp_path / "index")
    stores.append_consolidated(spark, rows_of(spark, 0, 10, 1.0), path)
    M.append_indexed(spark, rows_of(spark, 5, 20, 2.0), path, index, 1000)
    assert [(m, lat) for m, _, lat in stored_keys(spark, path)] == [(m, 1.0 if m < 10 else 2.0) for m in range(20)]


def test_only_dates_of_candidates_are_read(spark, tmp_path):
    path, index = str(tmp_path / "all"), str(tmp_path / "index")
    for d in range(1, 6):
        M.append_indexed(spark, rows_of(spark, 0, 30, 1.0, f"2024-01-0{d}"), path, index, 1000)
    new = rows_of(spark, 0, 5, 2.0, "2024-01-03")
    candidates = M.possible_repeats(new, spark.read.parquet(index), 1000)
    assert {str(r.stored_date) for r in candidates.collect()} == {"2024-01-03"}
    found = M.repeats_of(spark.read.parquet(path), candidates)
    read = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line and "/all" in line]
    assert read and all("file_date" in line.split("PartitionFilters")[1] for line in read)
    assert found.count() == 5
    # Keys that no filter knows meet no stored row at all.
    assert M.possible_repeats(rows_of(spark, 900, 905, 2.0, "2024-02-01"), spark.read.parquet(index), 1000).count() == 0
