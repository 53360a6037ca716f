"""Streams of pings: late rows, restarts, silent vessels, silences of exactly the limit."""

from datetime import timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from helmtrace.operators import tracks as K
from helmtrace.streaming import tracks as live
from tests.helpers import at, ping, table


class Played:
    """A folder that receives pings, and what a stream over it has written so far."""

    def __init__(self, spark, folder, operator):
        self.spark, self.source, self.out, self.log = spark, str(folder / "in"), str(folder / "out"), str(folder / "log")
        self.operator, self.schema = operator, table(spark, []).schema

    def send(self, *rows):
        table(self.spark, list(rows)).coalesce(1).write.mode("append").parquet(self.source)
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.source)
        live.write_available(self.operator(stream), self.out, self.log)
        return sorted(self.spark.read.parquet(self.out).collect(), key=str)


def hours(start, *offsets):
    return [at(start) + timedelta(hours=h) for h in offsets]


def test_alerts_of_a_vessel_that_never_returns_and_one_that_does(spark, tmp_path):
    run = Played(spark, tmp_path, live.gap_alerts)
    t0, t1 = hours("2024-01-01 00:00:00", 0, 2)
    assert run.send(ping(1, t0, lat=1.0), ping(2, t0), ping(2, t1, lat=None, lon=None)) == []
    # Vessel 3 moves the watermark to 08:30: vessel 1 is overdue since 06:00, vessel 2 since 08:00.
    out = run.send(ping(3, t0 + timedelta(hours=9, minutes=30)))
    assert [(r.MMSI, r.kind, r.last_time, r.alert_time, r.LAT) for r in out] == [
        (1, "silent", t0, t0 + timedelta(hours=6), 1.0), (2, "silent", t1, t1 + timedelta(hours=6), None),
    ]
    # A restart from the log: vessel 2 comes back, vessel 1 is not told again.
    out = run.send(ping(2, t0 + timedelta(hours=20)), ping(3, t0 + timedelta(hours=20)))
    new = [r for r in out if r.MMSI == 2 and r.kind == "back"]
    assert len(new) == 1 and new[0].silence_hours == 18.0 and sum(r.MMSI == 1 for r in out) == 1
    assert [r.kind for r in out if r.MMSI == 3] == ["back", "silent"]


def test_alerts_within_a_batch_late_rows_and_the_exact_limit(spark, tmp_path):
    run = Played(spark, tmp_path, live.gap_alerts)
    a = hours("2024-01-01 00:00:00", 0, 6, 12, 18.001)
    out = run.send(*[ping(1, t) for t in a], ping(2, a[0]), ping(None, a[0]), ping(5, None))
    # Steps of exactly six hours are no silence; the last one is a moment longer.
    assert [(r.kind, r.last_time) for r in out if r.MMSI == 1] == [("back", a[2]), ("silent", a[2])]
    assert [r.kind for r in out if r.MMSI == 2] == ["silent"]
    # The watermark is at 17:00: an older ping of vessel 2 is too late, one of vessel 1 at 17:30 is older than its last.
    out = run.send(ping(2, a[1]), ping(1, a[2] + timedelta(hours=5.5)))
    assert len(out) == 3


def test_tracks_close_and_equal_the_batch(spark, tmp_path):
    run = Played(spark, tmp_path, live.session_tracks)
    a = hours("2024-01-01 00:00:00", 0, 6, 12, 18.001, 19, 19.5)
    b = hours("2024-01-01 00:00:00", 1, 1.5, 9, 11)
    first = [ping(1, t) for t in a[:3]] + [ping(2, t) for t in b] + [ping(4, a[0], lat=None), ping(4, a[0] + timedelta(hours=2), lat=None)]
    # The watermark is at 11:00: nothing is seven hours behind but the tracks of vessels 2 (half an hour long) and 4 (no position).
    assert run.send(*first) == []
    rest = [ping(1, t) for t in a[3:]] + [ping(9, a[0] + timedelta(days=3)), ping(9, a[0] + timedelta(days=3, hours=2))]
    # Tracks close in the batch after the watermark has moved on; a new run goes on from the log.
    run.send(*rest)
    out = run.send(ping(9, a[0] + timedelta(days=3, hours=2, minutes=1)))
    batch = K.track_segments(table(spark, first + rest)).where(F.col("MMSI") != 9)
    want = sorted(((r.MMSI, r.start, r.end, r.points, r.span_hours) for r in batch.collect()), key=str)
    assert sorted((tuple(r) for r in out), key=str) == want
    assert [(r.MMSI, r.points) for r in out] == [(1, 3), (1, 3), (2, 2)]


class Held:
    """One vessel's state and timers, and the calls that reached them."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


def test_a_vessel_of_a_batch_is_plain_rows_and_four_calls_to_its_state():
    handle, hour = Held(), 3_600_000_000
    silences = live._Silences(6.0)
    silences.init(handle)
    nan = float("nan")
    rows = [Row(time=t * hour, LAT=lat, LON=lon) for t, lat, lon in ((9, 1.0, 2.0), (0, nan, None), (0, 3.0, -0.0), (2, nan, 5.0))]
    out = list(silences.handleInputRows((7,), iter(rows), None))
    assert [(r.MMSI, r.kind, r["last"], r.LAT, r.LON, r.at) for r in out] == [(7, "silent", 2 * hour, None, 5.0, 8 * hour), (7, "back", 2 * hour, None, 5.0, 9 * hour)]
    assert handle.value == (9 * hour, 1.0, 2.0, False) and handle.timers == {15 * 3_600_000 + 1}
    handle.calls = 0
    assert list(silences.handleInputRows((7,), iter([Row(time=10 * hour, LAT=None, LON=None)]), None)) == []
    assert handle.calls == 4 and handle.timers == {16 * 3_600_000 + 1}
