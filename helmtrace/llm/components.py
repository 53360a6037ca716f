"""Connected components of an edge table, by alternating star contraction.

Every round is joins and partial aggregates over edges; a hub with a third of all edges is only a
skewed join key, which adaptive execution splits, and its minimum is combined map-side. Rounds are cut by
written tables in the shared folder. Nothing but two counters reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helmtrace.llm.common import drop_stored, stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than ``u`` is moved to the smallest node around ``u``."""
    ways = _both_ways(edges)
    least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = ways.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour not larger than ``u``, and ``u``, is moved to the smallest of them."""
    least = edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
    moved = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u")
    pairs = moved.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return pairs.where("a != b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of an edge; ``component`` is its smallest reachable node.

    ``edges`` has the columns ``a, b``; order, repeats, self-links and rows with a null do not matter.
    A node without an edge to another is not returned. Raises if ``max_rounds`` do not suffice
    (rounds grow with the logarithm of the longest path).
    """
    spark = edges.sparkSession
    clean = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = stored(clean, "edges")
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
                now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            )
        before = state
        later = stored(_small_star(_large_star(now)), "edges")
        drop_stored(spark, now)
        now = later
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
