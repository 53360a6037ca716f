"""Centroid clustering: every vector to the nearest of k centroids, found in a vantage-point tree.

The tree over the centroids is built anew and broadcast each round; its size goes with k, a parameter. A vector
opens the nodes of the tree in the order of their lower bounds (best first) and stops when the least bound lies
beyond its best distance. Bounds come from the triangle inequality in doubles and are widened by more than
their rounding, and a bound equal to the best distance is still opened: a tie with a smaller number is never missed.
Distances to vantage points and to the centroids of a leaf are exact whole numbers. The vectors of a batch go
through the tree together, each with its own queue, in numpy.

A task sends the exact sums of its vectors by cluster; the driver holds k centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helmtrace.llm import whole_vectors as wv
from helmtrace.llm.common import drop_stored, stored

FACTOR = 64
SIZE = 64
CLUSTERS = 16
ROUNDS = 3
LEAF = 3
#: Wider than the rounding of two square roots and their difference.
_SLACK = 1e-9
_CELLS = 1 << 21


class Node(NamedTuple):
    """A leaf (``members``) or a vantage point and two children with the range of their distances from it."""

    members: tuple[int, ...]
    vantage: int
    children: tuple[tuple[int, float, float], ...]  # number of the node, least and largest distance


class Tree(NamedTuple):
    centroids: np.ndarray
    nodes: list[Node]


def _distances(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    return wv.square_sums(wv.minus(x, centroid))


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def build(centroids: np.ndarray) -> Tree:
    """The tree over the rows of ``centroids``; a vantage point is the centroid farthest from the first of its group."""
    nodes: list[Node | None] = []

    def grow(group: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(None)
        if len(group) <= LEAF:
            nodes[at] = Node(tuple(int(g) for g in group), -1, ())
            return at
        vantage = int(group[np.argmax(_distances(centroids[group], centroids[group[0]]))])
        group = group[group != vantage]
        far = _distances(centroids[group], centroids[vantage])
        order = np.argsort(far, kind="stable")
        half = len(order) // 2
        children = []
        for part in (order[:half], order[half:]):
            reach = _roots(far[part])
            children.append((grow(group[part]), float(reach.min()), float(reach.max())))
        nodes[at] = Node((), vantage, tuple(children))
        return at

    grow(np.arange(len(centroids)))
    return Tree(centroids, nodes)


def nearest(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of every row; of equal ones the smallest number."""
    rows = len(x)
    who = np.full(rows, len(tree.centroids), dtype=np.int64)
    best = np.full(rows, -1, dtype=object if wv.largest(x, tree.centroids) >= 2**27 else np.int64)
    reach = np.full(rows, np.inf)
    queue = np.full((rows, len(tree.nodes)), np.inf)
    queue[:, 0] = 0.0

    def offer(at: np.ndarray, number: int) -> np.ndarray:
        far = _distances(x[at], tree.centroids[number])
        better = (best[at] < 0) | (far < best[at]) | ((far == best[at]) & (number < who[at]))
        won = at[better]
        best[won], who[won] = far[better], number
        root = _roots(far)
        reach[won] = root[better] * (1 + _SLACK)
        return root

    waiting = np.arange(rows)
    while len(waiting):
        node = queue[waiting].argmin(axis=1)
        least = queue[waiting, node]
        opened = (least <= reach[waiting]) & np.isfinite(least)
        waiting, node = waiting[opened], node[opened]
        queue[waiting, node] = np.inf
        for number in np.unique(node):
            at = waiting[node == number]
            here = tree.nodes[number]
            for member in here.members:
                offer(at, member)
            if here.vantage >= 0:
                root = offer(at, here.vantage)
                for child, low, high in here.children:
                    bound = np.maximum(np.maximum(low - root, root - high), 0.0)
                    queue[at, child] = bound - _SLACK * (root + high)
    return who, best


def _found(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = max(64, _CELLS // max(1, len(tree.nodes)))
    parts = [nearest(tree, x[lo : lo + step]) for lo in range(0, len(x), step)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _cluster_sums(rows: DataFrame, tree: Tree) -> dict[tuple[int, int, int], int]:
    """By cluster: its count (position 0) and the sums of its vectors' components (from position 1)."""
    sent = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in wv.matrices(batch.column(0)):
                who, _ = _found(sent.value, x)
                for number in np.unique(who):
                    mine = x[who == number]
                    row = np.concatenate([[len(mine)], wv.column_sums(mine)]).astype(object)
                    total[int(number)] = total.get(int(number), 0) + row
        yield wv.partial_rows({(number, i, 0): v for number, row in total.items() for i, v in enumerate(row)})

    out = wv.added(rows.select("x").mapInArrow(run, wv.PARTIAL))
    sent.unpersist()
    return out


def _moved(centroids: np.ndarray, sums: dict[tuple[int, int, int], int]) -> np.ndarray:
    """Non-empty centroids become the floor of their vectors' mean; empty ones stay."""
    out = centroids.astype(object)
    for number in range(len(centroids)):
        count = sums.get((number, 0, 0), 0)
        if count:
            out[number] = [sums.get((number, i + 1, 0), 0) // count for i in range(centroids.shape[1])]
    return out.astype(np.int64)


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    factor: int = FACTOR, size: int = SIZE,
) -> DataFrame:
    """One row per kept vector: ``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Kept are vectors with exactly ``size`` components, none null, NaN or infinite; components become
    floor(factor * component). The first centroids are the ``clusters`` kept vectors with the smallest SHA-256 of ``1:id``; of
    rows that share an id the one with the smaller vector comes first. Fewer kept vectors give fewer centroids, none give no rows.
    Equal centroids leave the larger number empty; it stays where it is. A row with a null id is assigned but
    never a first centroid (no row is returned if no id is left). Repeated rows count and are returned each. A distance
    or inertia of more than 64 bits is null. Other columns, also of clashing names, are not returned.
    """
    spark = vectors.sparkSession
    vector = F.col(f"`{vector_col}`")
    kept = vectors.where(wv.finite(vector) & (F.size(vector) == size))
    rows = stored(kept.select(F.col(f"`{id_col}`").alias("id"), wv.lattice(vector, factor).alias("x")), "kept-vectors")
    named = rows.where("id IS NOT NULL").withColumn("draw", F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256))
    # Bounded by a parameter: the first centroids.
    start = named.orderBy("draw", "x").limit(clusters).collect()
    out = T.StructType([rows.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not start:
        empty = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string".split(", ")
        nothing = spark.createDataFrame([], T.StructType([rows.schema["id"]]))
        return nothing.select(F.col("id").alias(id_col), *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in empty])
    centroids = np.array([r["x"] for r in start], dtype=np.int64)
    for _ in range(rounds):
        centroids = _moved(centroids, _cluster_sums(rows, build(centroids)))
    sent = spark.sparkContext.broadcast(build(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in wv.matrices(batch.column(1)):
                who, far = _found(sent.value, x)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(who.astype(np.int32)), wv.longs(far)], names=out.names)

    assigned = stored(rows.mapInArrow(run, out), "assigned")
    sent.unpersist()
    drop_stored(spark, rows)
    # One row per cluster.
    sums = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    inertia = sum(int(v or 0) for v in sums.values())
    named = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = [(n, _long(sums.get(n)), _long(inertia), named[n]) for n in range(len(centroids))]
    told = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _long(value: object) -> int | None:
    return None if value is None or abs(int(value)) > wv.LARGEST else int(value)
