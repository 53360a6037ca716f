"""Pings as a stream: alerts on silent vessels, and tracks that close by themselves.

Both keep one small state row per vessel or open track. A watermark bounds how late a ping may come; what is later is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers need; set it before the query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_ALERT = T.StructType(
    [
        T.StructField("MMSI", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("last", T.LongType()),
        T.StructField("LAT", T.DoubleType()),
        T.StructField("LON", T.DoubleType()),
        T.StructField("at", T.LongType()),
        T.StructField("silence_hours", T.DoubleType()),
    ]
)
_LAST = T.StructType(
    [
        T.StructField("time", T.LongType()),
        T.StructField("LAT", T.DoubleType()),
        T.StructField("LON", T.DoubleType()),
        T.StructField("alerted", T.BooleanType()),
    ]
)


class _Silences(StatefulProcessor):
    """Last ping of a vessel in microseconds, and one timer at the end of its allowed silence."""

    def __init__(self, gap_hours: float):
        self.gap = round(gap_hours * 3_600_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _LAST)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        pings = sorted(((r.time, _value(r.LAT), _value(r.LON)) for r in rows), key=_order)
        held = self.last.get()
        if held is not None and not held[3]:
            self.handle.deleteTimer(self._due(held[0]))
        out = []
        for time, lat, lon in pings:
            if held is not None and time - held[0] > self.gap:
                # A silence whose end is seen before its timer fired, or after.
                if not held[3]:
                    out.append(self._row(key, "silent", held, held[0] + self.gap))
                out.append(self._row(key, "back", held, time))
            if held is None or time >= held[0]:
                held = (time, lat, lon, False)
        if not held[3]:
            self.handle.registerTimer(self._due(held[0]))
        self.last.update(held)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.last.get()
        # A timer counts whole milliseconds; one that a later ping has overtaken is of no use.
        if held[3] or expiredTimerInfo.getExpiryTimeInMs() < self._due(held[0]):
            return iter([])
        self.last.update((held[0], held[1], held[2], True))
        return iter([self._row(key, "silent", held, held[0] + self.gap)])

    def close(self) -> None:
        pass

    def _due(self, time: int) -> int:
        """The first whole millisecond at which the silence is longer than allowed."""
        return (time + self.gap) // 1000 + 1

    @staticmethod
    def _row(key, kind: str, held: tuple, at: int) -> Row:
        return Row(
            MMSI=int(key[0]), kind=kind, last=held[0], LAT=held[1], LON=held[2], at=at, silence_hours=(at - held[0]) / 3_600_000_000
        )


def _value(number: float | None) -> float | None:
    """A number, or None where it is missing or NaN."""
    return None if number is None or number != number else number


def _order(ping: tuple) -> tuple:
    """Time, then position; a missing number comes last."""
    time, lat, lon = ping
    return time, lat is None, lat or 0.0, lon is None, lon or 0.0


def gap_alerts(pings: DataFrame, gap_hours: float = 6.0, lateness: str = "1 hour") -> DataFrame:
    """A stream of alerts on vessels that stay silent for more than ``gap_hours``.

    ``silent``: the watermark has passed the last ping by the limit and no other came; ``alert_time`` is the limit's end, and
    a vessel that never returns has this one. ``back``: the next ping after such a silence; ``alert_time`` is its time. A silence of
    exactly the limit is none. ``pings`` streams the ping layout; rows without a vessel or time are dropped, rows later
    than ``lateness`` behind the newest may be. A ping that is older than the vessel's last one changes nothing. State is one row
    per vessel. The session must use ``STATE_STORE``.
    """
    rows = pings.where(F.col("MMSI").isNotNull() & F.col("BaseDateTime").isNotNull())
    rows = rows.withWatermark("BaseDateTime", lateness).select("MMSI", "LAT", "LON", F.unix_micros("BaseDateTime").alias("time"), "BaseDateTime")
    # Plain rows: a vessel has few pings in a batch, and a frame for each costs more than all the rest.
    alerts = rows.groupBy("MMSI").transformWithState(_Silences(gap_hours), outputStructType=_ALERT, outputMode="Append", timeMode="EventTime")
    return alerts.select(
        "MMSI", "kind", F.timestamp_micros("last").alias("last_time"), "LAT", "LON", F.timestamp_micros("at").alias("alert_time"), "silence_hours"
    )


def session_tracks(pings: DataFrame, max_gap_hours: float = 6.0, min_points: int = 2, min_hours: float = 1.0, lateness: str = "1 hour") -> DataFrame:
    """A stream of closed tracks: ``MMSI, start, end, points, span_hours``.

    Pings of a vessel belong to one track while no step is longer than ``max_gap_hours``; a step of exactly that stays inside, as in
    the batch (a session window alone would split there, so it is a microsecond longer than the limit). A track leaves once
    the watermark has passed its end by the limit; the last one of each vessel stays in the state until later pings of
    any vessel move the watermark on. Tracks of fewer than ``min_points`` pings, of less than ``min_hours``, or without any position are left
    out, as in ``segment_tracks``. Rows without a time are dropped; state is one row per open track.
    """
    # Whole microseconds, and one more: at the limit itself two sessions still touch.
    limit = round(max_gap_hours * 3_600_000_000) + 1
    rows = pings.where(F.col("BaseDateTime").isNotNull()).withWatermark("BaseDateTime", lateness)
    session = F.session_window("BaseDateTime", f"{limit // 1_000_000} seconds {limit % 1_000_000} microseconds")
    sessions = rows.groupBy("MMSI", session.alias("session")).agg(
        F.min("BaseDateTime").alias("start"),
        F.max("BaseDateTime").alias("end"),
        F.count(F.lit(1)).alias("points"),
        F.count("LAT").alias("with_lat"),
        F.count("LON").alias("with_lon"),
    )
    hours = (F.unix_micros("end") - F.unix_micros("start")) / 3_600_000_000
    usable = (F.col("points") >= min_points) & (F.col("span_hours") >= min_hours) & (F.col("with_lat") > 0) & (F.col("with_lon") > 0)
    return sessions.withColumn("span_hours", hours).where(usable).select("MMSI", "start", "end", "points", "span_hours")


def write_available(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Takes what has arrived, appends the results to a Parquet table, and ends once nothing is left to do.

    ``checkpoint`` and ``target`` lie in storage all executors share; the next run goes on from there.
    """
    stream.sparkSession.conf.set(*STATE_STORE)
    writer = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
