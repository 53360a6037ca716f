import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from helmtrace.operators import anomalies as A
from helmtrace.operators import cleaning as C
from helmtrace.operators import detectors as D
from helmtrace.operators.days import day_table
from helmtrace.plans.detection import all_anomalies, detect_anomalies, prepare
from helmtrace.schemas import ANOMALY_TYPES, Params
from tests.helpers import at, minutes, ping, table


def found(spark, rows, kind, params=Params(), zones=None):
    out = all_anomalies(table(spark, rows), zones, params)
    return out.filter(F.col("AnomalyType") == kind).orderBy("MMSI", "Date").collect()


def keep_days(*days):
    """A vessel that reports on every day, so that the days are loaded and not empty."""
    return [ping(1, f"{d} 12:00:00", lat=0.0, lon=0.0) for d in days]


def test_beacon_threshold_is_inclusive(spark):
    rows = keep_days("2024-01-01", "2024-01-02") + [
        ping(2, "2024-01-02 06:00:00"),
        ping(3, "2024-01-02 05:59:59"),
    ]
    hits = found(spark, rows, "AIS_Beacon_On")
    assert [(r.MMSI, r.BeaconGapMinutes) for r in hits] == [(2, 360.0)]


def test_beacon_off_is_reported_on_the_next_loaded_day(spark):
    rows = keep_days("2024-01-01", "2024-01-04") + [
        ping(2, "2024-01-01 17:59:59"),
        ping(3, "2024-01-01 18:00:00"),
    ]
    hits = found(spark, rows, "AIS_Beacon_Off")
    assert [(r.MMSI, r.Date, r.BeaconGapMinutes) for r in hits] == [(2, date(2024, 1, 4), 360.0)]


def test_missing_date_is_no_gap_but_an_empty_day_is(spark):
    jump = [ping(2, "2024-01-01 23:00:00", lat=10.0), ping(2, "2024-01-02 01:00:00", lat=20.0)]
    # The second file holds pings dated late on the day before, so the time step stays short.
    rows = keep_days("2024-01-01", "2024-01-03") + [jump[0], ping(2, "2024-01-02 01:00:00", lat=20.0, day=date(2024, 1, 3))]
    assert len(found(spark, rows, "Speed")) == 1
    # A listed day whose rows are all refused leaves the day after without a previous day.
    rows.append(ping(9, "2024-01-02 12:00:00", lat=95.0))
    assert found(spark, rows, "Speed") == []
    assert found(spark, rows, "AIS_Beacon_On") == []


def test_first_loaded_day_has_no_anomalies(spark):
    rows = [ping(2, "2024-01-01 12:00:00", sog=12.0, cog=0.0, heading=90.0)]
    rows += [ping(2, "2024-01-02 12:00:00", sog=12.0, cog=0.0, heading=90.0)]
    assert [r.Date for r in found(spark, rows, "Course")] == [date(2024, 1, 2)]
    assert len(found(spark, rows, "Course", Params(include_first_day=True))) == 2


def test_speed_time_limits(spark):
    rows = keep_days("2024-01-01", "2024-01-02") + [
        ping(2, "2024-01-01 22:00:00", lat=0.0), ping(2, "2024-01-02 02:00:00", lat=20.0),
        ping(3, "2024-01-01 22:00:00", lat=0.0), ping(3, "2024-01-02 02:00:01", lat=20.0),
        # Same instant in both files: infinite speed when moved, none when not.
        ping(4, "2024-01-01 23:00:00", lat=0.0), ping(4, "2024-01-01 23:00:00", lat=1.0, day=date(2024, 1, 2)),
        ping(5, "2024-01-01 23:00:00", lat=0.0), ping(5, "2024-01-01 23:00:00", lat=0.0, day=date(2024, 1, 2)),
        # The later file is earlier in time: a negative speed is no anomaly.
        ping(6, "2024-01-01 23:00:00", lat=0.0), ping(6, "2024-01-01 22:00:00", lat=9.0, day=date(2024, 1, 2)),
    ]
    hits = found(spark, rows, "Speed")
    assert [r.MMSI for r in hits] == [2, 4]
    assert math.isinf(hits[1].ImpliedSpeed)


def test_course_difference(spark):
    cases = [(2, 350.0, 10.0), (3, 0.0, 511.0), (4, 0.0, 45.0), (5, 0.0, 46.0), (6, None, 46.0)]
    rows = keep_days("2024-01-01") + [
        ping(m, "2024-01-02 12:00:00", sog=10.0, cog=c, heading=h) for m, c, h in cases
    ] + [ping(7, "2024-01-02 12:00:00", sog=9.9, cog=0.0, heading=90.0)]
    hits = found(spark, rows, "Course")
    assert [(r.MMSI, r.CourseHeadingDiff) for r in hits] == [(3, -151.0), (5, -46.0)]
    assert [r.MMSI for r in found(spark, rows, "Course", Params(drop_heading_511=True))] == [5]


def test_loitering(spark):
    def stay(mmsi, n, step, spread=0.0):
        return [ping(mmsi, t, lat=10.0 + spread * (i % 2)) for i, t in enumerate(minutes("2024-01-02 00:00:00", *range(0, n * step, step)))]

    rows = keep_days("2024-01-01") + stay(2, 13, 60) + stay(3, 9, 80) + stay(4, 13, 60, 1.0)
    params = Params(loitering_hours=12.0)
    hits = found(spark, rows, "Loitering", params)
    assert [(r.MMSI, r.LoiteringRecordCount, r.LoiteringDurationHours) for r in hits] == [(2, 13, 12.0)]
    assert found(spark, rows, "Loitering") == []


def test_identity_lists_all_names(spark):
    names = ["E", "D", "C", "B", "A", "F", None]
    rows = keep_days("2024-01-01") + [
        ping(2, t, name=n) for t, n in zip(minutes("2024-01-02 00:00:00", *range(7)), names)
    ] + [ping(3, t, name=n) for t, n in zip(minutes("2024-01-02 00:00:00", 0, 1), ["X", None])]
    hits = found(spark, rows, "Identity_Spoofing")
    assert [(r.MMSI, r.NameCount, r.VesselNames) for r in hits] == [(2, 6, "E, D, C, B, A, F")]


def nm(a, b):
    la, lo, lb, ob = (math.radians(x) for x in (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - lo) / 2) ** 2
    return 2 * 3440.1 * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize("center", [(0.0, 0.0), (24.0, 179.999), (-71.0, -180.0), (89.99, 10.0), (-89.995, 0.0)])
def test_rendezvous_equals_all_pairs(spark, center):
    rng = random.Random(f"{center}")
    wide = min(180.0, 0.02 / max(1e-3, math.cos(math.radians(center[0]))))
    spots = {
        m: (
            max(-90.0, min(90.0, center[0] + rng.uniform(-0.02, 0.02))),
            (center[1] + rng.uniform(-wide, wide) + 180) % 360 - 180,
        )
        for m in range(1, 61)
    }
    rows = [ping(m, t, lat=p[0], lon=p[1]) for m, p in spots.items() for t in minutes("2024-01-02 05:00:00", 1, 2, 3)]
    rows += keep_days("2024-01-01")
    clean, days = prepare(table(spark, rows))
    got = {(r.MMSI, r.RendezvousMMSI2) for r in D.rendezvous(clean, days).collect()}
    want = {(a, b) for a in spots for b in spots if a < b and nm(spots[a], spots[b]) < 0.5}
    assert want and got == want
    assert D.rendezvous(clean, days).count() == len(want)


def test_rendezvous_needs_three_reports_in_the_hour(spark):
    near = lambda m, k: [ping(m, t) for t in minutes("2024-01-02 05:00:00", *range(k))]
    rows = keep_days("2024-01-01") + near(2, 3) + near(3, 2) + near(4, 4)
    hits = found(spark, rows, "Rendezvous")
    assert [(r.MMSI, r.RendezvousMMSI2, r.TimeWindow) for r in hits] == [(2, 4, 5)]


def test_two_cleaners_treat_missing_speed_differently(spark):
    rows = table(spark, [ping(1, "2024-01-01", sog=None), ping(2, "2024-01-01", sog=float("nan")), ping(3, "2024-01-01")])
    assert [r.MMSI for r in C.clean_positions(rows).collect()] == [3]
    assert sorted(r.MMSI for r in C.clean_history(rows).collect()) == [1, 2, 3]


def test_main_type_grouping_compares_decades(spark):
    rows = table(spark, [ping(i, "2024-01-01", kind=k) for i, k in enumerate([70, 71, 80, None])])
    pick = lambda types: sorted(r.MMSI for r in C.filter_vessel_types(rows, types).collect())
    assert pick([70]) == [0, 1]
    assert pick([71]) == []
    assert pick([71, 30]) == [1]
    assert pick([]) == [0, 1, 2, 3]


def test_hours_equal_bounds_keep_all(spark):
    rows = table(spark, [ping(h, f"2024-01-01 {h:02d}:30:00") for h in range(24)])
    kept = lambda a, b: sorted(r.MMSI for r in A.filter_hours(rows, a, b).collect())
    assert kept(8, 17) == list(range(8, 17))
    assert kept(22, 4) == [0, 1, 2, 3, 22, 23]
    assert kept(5, 5) == list(range(24))


def test_cap_and_types(spark):
    rows = keep_days("2024-01-01") + [
        ping(2, t, sog=12.0, cog=0.0, heading=90.0) for t in minutes("2024-01-02 00:00:00", *range(30))
    ]
    full = all_anomalies(table(spark, rows))
    assert detect_anomalies(table(spark, rows)).filter("AnomalyType = 'Course'").count() == 30
    capped = detect_anomalies(table(spark, rows), params=Params(max_anomalies_per_vessel=10))
    assert full.filter("AnomalyType = 'Course'").count() == 30
    assert capped.groupBy("MMSI").count().agg(F.max("count")).first()[0] == 10
    none = all_anomalies(table(spark, rows), params=Params(enabled_types=[]))
    assert none.count() == 0 and none.columns == full.columns
    assert set(r.AnomalyType for r in full.collect()) <= set(ANOMALY_TYPES)


def test_day_table_of_gaps(spark):
    rows = table(spark, [ping(1, "2024-01-01", lat=99.0), ping(1, "2024-01-03"), ping(1, "2024-01-07")])
    days = {r.file_date.day: r for r in day_table(rows, F.col("LAT") < 90).collect()}
    assert [days[d].day_index for d in (1, 3, 7)] == [1, 2, 3]
    assert [days[d].is_first for d in (1, 3, 7)] == [False, True, False]
    assert not days[3].prev_has_rows and days[7].prev_date == at("2024-01-03").date()
    assert days[3].next_date - days[3].file_date == timedelta(days=4)
