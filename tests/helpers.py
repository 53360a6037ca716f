from datetime import datetime, timedelta

from helmtrace.schemas import PING_SCHEMA


def at(text):
    return datetime.fromisoformat(text)


def ping(mmsi, time, lat=10.0, lon=20.0, sog=5.0, cog=None, heading=None, name="A", kind=70, day=None):
    time = at(time) if isinstance(time, str) else time
    return (mmsi, name, kind, lat, lon, sog, cog, heading, time, day or (time.date() if time else None))


def table(spark, rows):
    return spark.createDataFrame(rows, PING_SCHEMA)


def minutes(start, *offsets):
    return [at(start) + timedelta(minutes=m) for m in offsets]
