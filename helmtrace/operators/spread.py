"""Ordered work on groups that may be very large.

One vessel may hold a large share of all rows, so no window here runs over the raw rows of
a whole vessel. Rows are first split into fixed time chunks; windows run inside
``(vessel, chunk)``, and what has to pass from chunk to chunk (a last row, a running count)
travels through a table with one row per vessel and chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmtrace.functions.times import HOUR_US, chunk_of, micros


def order_struct(df: DataFrame, ts: str = "BaseDateTime", skip: Sequence[str] = ()) -> Column:
    """All columns as one struct that sorts by time, then position, then the rest.

    ``min``/``max`` of it give a first or last row that does not depend on the row order.
    """
    head = [c for c in (ts, "LAT", "LON") if c in df.columns and c not in skip]
    rest = [c for c in df.columns if c not in head and c not in skip]
    return F.struct(*head, *rest)


# Columns a track table may bring along: the chunk it is partitioned by, the last row
# (WALK_FIELDS) of the chunk before in the same track, and the number of rows with a speed
# before the chunk.
WALK = ["time_chunk", "chunk_carry", "counted_before"]
WALK_FIELDS = ["BaseDateTime", "LAT", "LON", "SOG", "COG"]


def _rows_and_chunks(
    df: DataFrame,
    keys: list[str],
    fields: Sequence[str],
    counted: str | None,
    ts: str,
    order: Sequence[str],
    chunk_us: int,
) -> DataFrame:
    """Rows with what precedes them: ``_prev`` (a struct) and ``_nth`` (counted rows up to here)."""
    order = [c for c in order if c in df.columns]
    value = F.struct(ts, *order, *[f for f in fields if f not in (ts, *order)])
    one = F.lit(1) if counted is None else F.when(F.col(counted).isNotNull(), 1).otherwise(0)
    brought = all(c in df.columns for c in WALK)
    if brought and ts == WALK_FIELDS[0] and set(fields) <= set(WALK_FIELDS) and counted in ("SOG", None):
        # A chunk lies within one track, so the vessel and chunk are key enough.
        inside = Window.partitionBy("MMSI", "time_chunk").orderBy(*WALK_FIELDS[:3])
        before = F.lag(F.struct(*WALK_FIELDS)).over(inside)
        rows = df.withColumns({"_one": one, "_prev": F.coalesce(before, "chunk_carry")})
        if counted is None:
            return rows.withColumn("_nth", F.lit(None).cast("long")).drop(*WALK)
        upto = F.sum("_one").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return rows.withColumn("_nth", F.col("counted_before") + upto).drop(*WALK)
    rows = df.drop(*WALK).withColumns({"_chunk": chunk_of(ts, chunk_us), "_value": value, "_one": one})
    walk = Window.partitionBy(*keys).orderBy("_chunk")
    ends = rows.groupBy(*keys, "_chunk").agg(F.max("_value").alias("_last"), F.sum("_one").alias("_n"))
    ends = ends.select(
        *keys,
        "_chunk",
        F.lag("_last").over(walk).alias("_carry"),
        F.coalesce(F.sum("_n").over(walk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(ts, *order)
    rows = rows.withColumns(
        {
            "_inner": F.lag("_value").over(inside),
            "_upto": F.sum("_one").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        }
    )
    joined = rows.join(ends, [*keys, "_chunk"], "left")
    return joined.withColumns(
        {"_prev": F.coalesce("_inner", "_carry"), "_nth": F.col("_before") + F.col("_upto")}
    ).drop("_chunk", "_value", "_inner", "_carry", "_before", "_upto")


def add_previous(
    df: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str],
    ts: str = "BaseDateTime",
    order: Sequence[str] = ("LAT", "LON"),
    position: str | None = None,
    counted: str | None = None,
    chunk_us: int = HOUR_US,
) -> DataFrame:
    """Adds ``prev``: a struct of ``ts`` and ``fields`` of the preceding row of the same ``keys``.

    With ``position``, also adds the 0-based time position among the rows where the column
    ``counted`` is present (among all rows without one); the other rows get null.
    """
    if position and counted is None:
        df = df.drop(*WALK)
    rows = _rows_and_chunks(df, list(keys), fields, counted, ts, order, chunk_us)
    rows = rows.withColumnRenamed("_prev", "prev")
    if position:
        rows = rows.withColumn(position, F.when(F.col("_one") == 1, F.col("_nth") - 1).cast("long"))
    return rows.drop("_one", "_nth")


def add_position(
    df: DataFrame,
    keys: Sequence[str],
    name: str = "seq",
    ts: str = "BaseDateTime",
    order: Sequence[str] = ("LAT", "LON"),
    counted: str | None = None,
    chunk_us: int = HOUR_US,
) -> DataFrame:
    """Adds the 0-based time position within ``keys``; rows without ``counted`` get null."""
    return add_previous(df, keys, [], ts, order, name, counted, chunk_us).drop("prev")


def bracket(
    queries: DataFrame,
    pings: DataFrame,
    keys: Sequence[str],
    query_ts: str,
    fields: Sequence[str],
    ts: str = "BaseDateTime",
    chunk_us: int = HOUR_US,
) -> DataFrame:
    """As-of lookup both ways: adds ``before`` and ``after`` to each query row.

    ``before`` is the ping at or before the query time, ``after`` the one at or after it; among
    pings of the same time the first by position. ``fields`` start with LAT and LON. Both sides
    meet in one shuffle by key and time chunk; chunks without a ping on one side of the query
    get it from the table of chunk ends.
    """
    keys = list(keys)
    points = pings.select(
        *keys, F.col(ts).alias("_ts"), F.struct(F.col(ts).alias("ts"), *fields).alias("_point")
    )
    asks = queries.select(
        *keys, F.col(query_ts).cast("timestamp").alias("_ts"), F.struct(*queries.columns).alias("_query")
    )
    # A query without a time sorts before everything, so its ``after`` is the first ping.
    chunk = F.coalesce(chunk_of("_ts", chunk_us), F.lit(-(2**60)))
    merged = asks.unionByName(points, allowMissingColumns=True).withColumn("_chunk", chunk)

    # Turned round, the southernmost and westernmost of several pings at one time comes last.
    turned = F.struct(
        F.col("_point.ts").alias("ts"), (-F.col("_point.LAT")).alias("s"), (-F.col("_point.LON")).alias("w"), "_point"
    )
    edges = merged.groupBy(*keys, "_chunk").agg(
        F.max(F.when(F.col("_point").isNotNull(), turned))["_point"].alias("_last"),
        F.min("_point").alias("_first"),
    )
    walk = Window.partitionBy(*keys).orderBy("_chunk")
    edges = edges.select(
        *keys,
        "_chunk",
        F.last("_last", ignorenulls=True)
        .over(walk.rowsBetween(Window.unboundedPreceding, -1))
        .alias("_carry_before"),
        F.first("_first", ignorenulls=True)
        .over(walk.rowsBetween(1, Window.unboundedFollowing))
        .alias("_carry_after"),
    )
    is_ping = F.col("_point").isNotNull().cast("int")
    inside = Window.partitionBy(*keys, "_chunk")
    back = inside.orderBy("_ts", is_ping.desc(), F.desc("_point.LAT"), F.desc("_point.LON"))
    ahead = inside.orderBy("_ts", is_ping, "_point")
    merged = merged.withColumns(
        {
            "_before": F.last("_point", ignorenulls=True).over(
                back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
            "_after": F.first("_point", ignorenulls=True).over(
                ahead.rowsBetween(Window.currentRow, Window.unboundedFollowing)
            ),
        }
    )
    found = merged.filter(F.col("_query").isNotNull()).join(edges, [*keys, "_chunk"], "left")
    return found.select(
        "_query.*",
        F.coalesce("_before", "_carry_before").alias("before"),
        F.coalesce("_after", "_carry_after").alias("after"),
    )


def nearest_of(ts: str, before: str = "before", after: str = "after") -> Column:
    """The closer of two bracketing pings; the earlier one on a tie."""
    gap_before = micros(ts) - micros(F.col(before)["ts"])
    gap_after = micros(F.col(after)["ts"]) - micros(ts)
    return F.when(
        F.col(after).isNull() | (F.col(before).isNotNull() & (gap_before <= gap_after)), F.col(before)
    ).otherwise(F.col(after))


def modal_value(df: DataFrame, keys: Sequence[str], value: str, name: str | None = None) -> DataFrame:
    """Most frequent non-null value per key, the smallest one on a tie."""
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).count()
    best = F.min(F.struct((-F.col("count")).alias("c"), F.col(value).alias("v")))
    return counts.groupBy(*keys).agg(best["v"].alias(name or value))


def global_rank(
    df: DataFrame, parts: Sequence[str], shard: Column, order: Sequence[str | Column], name: str = "rank"
) -> DataFrame:
    """1-based position in ``(shard, order)`` within ``parts``, without one task per part.

    ``shard`` must not decrease along ``order`` and must take a bounded number of values.
    """
    parts = list(parts)
    rows = df.withColumn("_shard", shard)
    before = Window.partitionBy(*parts).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*parts, "_shard").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*parts, "_shard").orderBy(*order)))
    joined = rows.join(sizes.drop("_n"), [*parts, "_shard"])
    return joined.withColumn(name, F.col("_rn") + F.col("_offset")).drop("_shard", "_rn", "_offset")


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], bins: int = 256
) -> DataFrame:
    """Exact linear-interpolated percentiles per key, one column per quantile.

    Equal values are counted together first. Approximate quantiles of the distinct values only
    serve to cut them into bins of similar size; ranks inside a bin plus the sizes of the bins
    before it give exact ranks. No group is ever ordered in one task.
    """
    keys = list(keys)
    on = keys or ["_all"]
    source = df if keys else df.withColumn("_all", F.lit(1))
    counts = (
        source.filter(F.col(value).isNotNull())
        .groupBy(*on, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    cuts = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    shape = counts.groupBy(*on).agg(
        F.sum("_c").alias("_total"), F.percentile_approx("_v", cuts, F.lit(bins * 20)).alias("_cuts")
    )
    if not keys:
        shape = F.broadcast(shape)  # one row
    placed = counts.join(shape, on).withColumn(
        "_bin", F.size(F.filter("_cuts", lambda b: b <= F.col("_v")))
    )
    before = Window.partitionBy(*on).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*on, "_bin")
        .agg(F.sum("_c").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*on, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.withColumn("_upto", F.sum("_c").over(inside)).join(offsets, [*on, "_bin"])
    upto = F.col("_offset") + F.col("_upto")

    # A value holds the ranks [upto - count, upto); only those holding a wanted rank go on.
    wanted = {n: F.lit(float(p)) * (F.col("_total") - 1) for n, p in quantiles.items()}

    def held(rank: Column) -> Column:
        return F.when((rank < upto) & (rank >= upto - F.col("_c")), F.col("_v"))

    ends = {n: (held(F.floor(at)), held(F.ceil(at))) for n, at in wanted.items()}
    hit = F.coalesce(*[e for pair in ends.values() for e in pair]).isNotNull()
    picked = ranked.filter(hit).groupBy(*on, "_total").agg(
        *[F.max(low).alias(f"_low_{n}") for n, (low, _) in ends.items()],
        *[F.max(high).alias(f"_high_{n}") for n, (_, high) in ends.items()],
    )
    return picked.select(
        *keys,
        *[
            (
                F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * (at - F.floor(at))
            ).alias(n)
            for n, at in wanted.items()
        ],
    )
