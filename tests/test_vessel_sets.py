from helmtrace.operators import vessel_sets as W
from tests.helpers import ping, table


def sets_of(spark, days, **options):
    return W.daily_sets(table(spark, [ping(m, day) for day, vessels in days.items() for m in vessels]), **options)


DAYS = {"2024-01-01": [1, 2, 2, 3], "2024-01-02": [3, 4], "2024-01-05": [None, 3], "2024-01-06": [None], "2024-01-07": [9]}


def test_totals_and_changes_of_small_sets(spark):
    sets = sets_of(spark, DAYS)
    assert [tuple(r) for r in W.range_totals(sets, "2024-01-01", "2024-01-02").collect()] == [(2, 6, 4)]
    assert [tuple(r) for r in W.range_totals(sets, "2024-02-01", "2024-02-02").collect()] == [(0, 0, 0)]
    totals = {str(r.file_date)[-2:]: (r.records, r.vessels) for r in W.trailing_totals(sets, 2).collect()}
    assert totals == {"01": (4, 3), "02": (6, 4), "05": (2, 1), "06": (3, 1), "07": (2, 1)}
    changes = {str(r.file_date)[-2:]: tuple(r)[1:] for r in W.set_changes(sets).collect()}
    assert changes == {"02": (1, 2, 1), "05": (0, 1, 1), "06": (0, 1, 0), "07": (1, 0, 0)}


def test_merged_sets_equal_those_of_all_rows(spark):
    first, second = ({d: v[i::2] for d, v in DAYS.items() if v[i::2]} for i in (0, 1))
    merged = W.merge_sets(sets_of(spark, first), sets_of(spark, second))
    for sets in (merged, sets_of(spark, DAYS)):
        assert [tuple(r) for r in W.range_totals(sets, "2024-01-01", "2024-01-31").collect()] == [(5, 10, 5)]
    assert W.merge_sets(sets_of(spark, {}), sets_of(spark, {})).count() == W.set_changes(sets_of(spark, {})).count() == 0


def test_errors_stay_within_the_bound(spark):
    n, lg = 30_000, 10
    pings = spark.range(2 * n).selectExpr("CASE WHEN id < 30000 THEN id ELSE id - 15000 END AS MMSI", "date_add(DATE '2024-01-01', CAST(id DIV 30000 AS INT)) AS file_date")
    sets = W.daily_sets(pings, lg).cache()
    four_errors = 4 / 2 ** (lg / 2)
    total = W.range_totals(sets, "2024-01-01", "2024-01-02", lg).first().vessels
    assert abs(total - 1.5 * n) <= four_errors * 1.5 * n
    change = W.set_changes(sets).first()
    for got in tuple(change)[1:]:
        assert abs(got - n / 2) <= four_errors * 1.5 * n
    # A date costs one row of bounded size, whatever its vessels.
    assert all(len(r.vessels) <= 8 * 2 ** lg + 64 for r in sets.collect())
