"""Near-duplicate vectors by E8 lattice hashing.

A vector is scaled to length one and, in each of ``TABLES`` tables, projected at random onto
``PARTS`` times eight coordinates. Every eight are decoded to the nearest point of the lattice E8; the points
of a table together name a cell. The vector also enters the ``PROBES`` next cells (one lattice step away, by
distance), so a pair that a cell wall separates still meets. Only cells with two vectors go on.

A cell is verified in tasks, in double precision. Crowded cells are cut into chunks, and chunk
pairs are tasks of their own. A pair is counted only in the smallest cell that both vectors enter. What leaves
a task are counts per vector and a spanning forest of its links, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helmtrace.llm.common import stored
from helmtrace.llm.components import components

COSINE = 0.9
TABLES, PARTS, PROBES, SCALE, SEED = 24, 3, 3, 0.5, 20
CHUNK = 512


def nearest_e8(points: np.ndarray) -> np.ndarray:
    """The nearest E8 point of every row of eight: the better of the nearest in D8 and in D8 plus one half."""

    def d8(x: np.ndarray) -> np.ndarray:
        near = np.rint(x)
        error = x - near
        odd = np.flatnonzero(near.sum(axis=1) % 2)
        worst = np.abs(error[odd]).argmax(axis=1)
        near[odd, worst] += np.where(error[odd, worst] >= 0, 1, -1)
        return near

    whole, half = d8(points), d8(points - 0.5) + 0.5
    closer = ((points - whole) ** 2).sum(axis=1) <= ((points - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


@lru_cache(maxsize=1)
def shortest_e8() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.stack(out)


@lru_cache(maxsize=8)
def _projections(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, size])
    width = TABLES * PARTS * 8
    mixers = rng.integers(1, 2**63, size=PARTS * 8, dtype=np.uint64) | np.uint64(1)
    return rng.standard_normal((size, width)) * SCALE, rng.random(width) * 2, mixers


def _mixed(cells: np.ndarray, mixers: np.ndarray, table: int, size: int) -> np.ndarray:
    """A 64-bit name of lattice points ``(rows, PARTS * 8)`` of a table."""
    doubled = np.rint(cells * 2).astype(np.int64).astype(np.uint64)
    h = np.full(len(cells), (table + 1) * 0x9E3779B97F4A7C15 + size & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for k in range(doubled.shape[1]):
        h = (h ^ (doubled[:, k] * mixers[k])) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def cell_codes(unit: np.ndarray) -> np.ndarray:
    """Names of the cells that unit vectors enter, ``(rows, TABLES * (1 + PROBES))``."""
    rows, size = unit.shape
    matrix, offset, mixers = _projections(size)
    y = unit @ matrix + offset
    steps = shortest_e8()
    out = np.empty((rows, TABLES, 1 + PROBES), dtype=np.int64)
    at = np.arange(rows)
    for table in range(TABLES):
        part = y[:, table * PARTS * 8 : (table + 1) * PARTS * 8]
        home = np.concatenate([nearest_e8(part[:, 8 * p : 8 * p + 8]) for p in range(PARTS)], axis=1)
        # How much nearer each step of each part leads: the largest product with the residual.
        toward = np.concatenate([(part - home)[:, 8 * p : 8 * p + 8] @ steps.T for p in range(PARTS)], axis=1)
        best = np.argpartition(-toward, PROBES, axis=1)[:, :PROBES]
        out[:, table, 0] = _mixed(home, mixers, table, size)
        for k in range(PROBES):
            p, step = np.divmod(best[:, k], len(steps))
            moved = home.copy()
            columns = 8 * p[:, None] + np.arange(8)
            moved[at[:, None], columns] += steps[step]
            out[:, table, 1 + k] = _mixed(moved, mixers, table, size)
    return out.reshape(rows, -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _codes_column(vector: F.Column) -> F.Column:
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            out = pd.Series([None] * len(vectors), index=vectors.index, dtype=object)
            sizes = vectors.map(len).to_numpy()
            for size in np.unique(sizes):
                where = np.flatnonzero(sizes == size)
                for lo in range(0, len(where), 512):
                    some = where[lo : lo + 512]
                    codes = cell_codes(_unit(np.stack(vectors.iloc[some].tolist()).astype(np.float64)))
                    for i, row in zip(some, codes):
                        out.iat[i] = np.unique(row)
            yield out

    return run(vector)


def _block_links(cell: int, crossing: bool, ids: np.ndarray, weights: np.ndarray, first: np.ndarray, unit: np.ndarray, codes: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links counted here per vector, and the smallest vector of this block that each one reaches."""
    linked = unit @ unit.T >= least
    np.fill_diagonal(linked, False)
    if crossing:
        linked &= first[:, None] != first[None, :]
    count = np.zeros(len(ids), dtype=np.int64)
    if linked.any():
        owner = np.repeat(np.arange(len(ids)), [len(c) for c in codes])
        flat = np.concatenate(codes)
        earlier = flat < cell
        names, spot = np.unique(flat[earlier], return_inverse=True)
        often = np.bincount(spot, minlength=len(names)) > 1
        place = np.cumsum(often) - 1
        keep = often[spot]
        inside = np.zeros((len(ids), int(often.sum())), dtype=np.float32)
        inside[owner[earlier][keep], place[spot[keep]]] = 1
        count = ((linked & (inside @ inside.T == 0)) * weights[None, :]).sum(axis=1)
    reach = np.arange(len(ids))
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), dtype=np.int64)
    rank[order] = np.arange(len(ids))
    label = rank.copy()
    while True:
        spread = np.minimum(label, np.where(linked, label[None, :], len(ids)).min(axis=1)) if len(ids) else label
        if (spread == label).all():
            break
        label = spread
    reach = order[label]
    return count, ids[reach]


_OUT = T.StructType([T.StructField("v", T.LongType()), T.StructField("least", T.LongType()), T.StructField("n", T.LongType())])


def _verify(blocks: DataFrame, least: float) -> DataFrame:
    """``blocks`` lies sorted by ``cell, i, j``; a group that two batches share is read whole."""

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            if not len(batch):
                continue
            key = batch[["cell", "i", "j"]].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts[:-1]], cuts):
                yield batch.iloc[lo:hi]
            held = batch.iloc[cuts[-1] if len(cuts) else 0 :]
        if held is not None and len(held):
            yield held

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for g in groups(batches):
            if len(g) > 1:
                unit = _unit(np.stack(g["vector"].tolist()).astype(np.float64))
                ids = g["v"].to_numpy()
                first = g["chunk"].to_numpy()
                crossing = bool(g["i"].iat[0] != g["j"].iat[0])
                count, reach = _block_links(int(g["cell"].iat[0]), crossing, ids, g["w"].to_numpy(), first, unit, g["codes"].tolist(), least)
                some = (count > 0) | (reach != ids)
                out += zip(ids[some].tolist(), reach[some].tolist(), count[some].tolist())
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=_OUT.names)
                out = []
        yield pd.DataFrame(out, columns=_OUT.names).astype("int64")

    return blocks.mapInPandas(run, _OUT)


def link_vectors(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """Per pair of distinct vectors that share a cell, what ``_verify`` returns; ``vectors`` has ``v, w, vector``."""
    coded = stored(vectors.select("v", "w", "vector", _codes_column(F.col("vector")).alias("codes")), "lattice")
    entered = coded.select("v", F.explode("codes").alias("cell"))
    shared = entered.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    met = entered.join(shared, "cell").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    met = met.withColumn("chunk", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int"))
    pairs = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "cell", "v", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")
    )
    blocks = pairs.join(coded, "v").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "v")
    return _verify(blocks, least)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = COSINE) -> DataFrame:
    """One row per vector: ``id_col, n_links, component_id, kept``.

    ``n_links`` counts other rows with a cosine of at least ``least`` (copies of the vector too),
    ``component_id`` is the smallest id reachable over links. Vectors that are null, empty, all zero or hold
    a null, NaN or infinity link with nothing; neither do vectors of different lengths. A row with a null id is
    returned, with a null ``component_id`` unless it is linked, and ``kept`` false. Equal vectors are one
    node; repeated rows of an id count as rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = (
        F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    rows = stored(rows.withColumn("name", F.when(sound, F.sha2(F.concat_ws(",", F.col("vector").cast("array<string>")), 256))), "vectors")
    # Equal vectors share a name of 256 bits; the smallest row number of a name is the node.
    nodes = rows.where("name IS NOT NULL").groupBy("name").agg(
        F.min("id").alias("least_id"), F.count("*").alias("w"), F.first("vector").alias("vector")
    )
    nodes = stored(nodes.withColumn("v", F.monotonically_increasing_id()), "nodes")
    found = stored(link_vectors(nodes.select("v", "w", "vector"), least), "links")
    counts = found.groupBy("v").agg(F.sum("n").alias("n_links"))
    joined = components(found.where("v != least").select(F.col("v").alias("a"), F.col("least").alias("b")))
    members = nodes.select("v", "least_id").join(joined, F.col("v") == F.col("node")).select("v", "component", "least_id")
    ids = members.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = members.join(ids, "component").select("v", "component_id")
    told = (
        nodes.select("name", "v", "w", "least_id")
        .join(counts, "v", "left")
        .join(named, "v", "left")
        .select(
            "name",
            (F.coalesce("n_links", F.lit(0)) + F.col("w") - 1).alias("n_links"),
            F.coalesce("component_id", "least_id").alias("component_id"),
        )
    )
    return (
        rows.select("id", "name")
        .join(told, "name", "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("name").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
    )
