"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Entries are rounded to whole numbers, so the sums, the scatter and the deviations are exact and do not
depend on how rows are dealt out. Three passes: sums of the distinct vectors, their scatter around the nearest
whole centre (corrected exactly for the difference to the mean), and the covariance of what was whitened.
A task sends one row per cell of its d by d partial sum; the driver holds d by d numbers and a model of
d by ``KEEP``.

The factor L of the scatter (L times its transpose) has the square roots of the eigenvalues as singular
values. Jacobi rotations from the right make its columns orthogonal; their norms squared are then the eigenvalues and
the normalised columns the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helmtrace.llm import whole_vectors as wv
from helmtrace.llm.common import stored

FACTOR = 256
KEEP = 4
_ROWS = 2_048
_EPS = float(np.finfo(np.float64).eps)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """``L`` with ``L @ L.T == a`` for a positive semidefinite ``a``, one column per pivot, largest rest first.

    Rows stay in the order of ``a``; in the order of the pivots they are a lower triangle. Ends where what is left
    of the diagonal is rounding noise, so the number of columns is the rank.
    """
    size = len(a)
    rest = a.diagonal().astype(np.float64).copy()
    least = size * _EPS * max(rest.max(initial=0.0), 0.0)
    factor = np.zeros((size, size))
    free = np.ones(size, dtype=bool)
    for k in range(size):
        pivot = int(np.where(free, rest, -np.inf).argmax())
        if not rest[pivot] > least:
            return factor[:, :k]
        free[pivot] = False
        column = (a[:, pivot] - factor[:, :k] @ factor[pivot, :k]) / np.sqrt(rest[pivot])
        factor[:, k] = np.where(free, column, 0.0)
        factor[pivot, k] = np.sqrt(rest[pivot])
        rest = rest - factor[:, k] ** 2
    return factor


def _tournament(count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of columns once per sweep, in rounds of disjoint pairs."""
    seats = np.arange(count + count % 2)
    for _ in range(len(seats) - 1):
        left, right = seats[: len(seats) // 2], seats[::-1][: len(seats) // 2]
        real = (left < count) & (right < count)
        yield left[real], right[real]
        seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Unit columns and squared norms of ``factor`` rotated until its columns are orthogonal, largest first."""
    g = np.array(factor, dtype=np.float64)
    for _ in range(sweeps):
        turned = False
        for p, q in _tournament(g.shape[1]):
            x, y = g[:, p], g[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            wrong = np.abs(xy) > 8 * _EPS * np.sqrt(xx * yy)
            if not wrong.any():
                continue
            turned = True
            p, q, x, y, xx, yy, xy = p[wrong], q[wrong], x[:, wrong], y[:, wrong], xx[wrong], yy[wrong], xy[wrong]
            zeta = (yy - xx) / (2 * xy)
            tangent = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cosine = 1 / np.hypot(1.0, tangent)
            g[:, p], g[:, q] = cosine * (x - tangent * y), cosine * (y + tangent * x)
        if not turned:
            break
    values = (g * g).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > 0]
    return g[:, order] / np.sqrt(values[order]), values[order]


class Model(NamedTuple):
    """What whitens the vectors of one length."""

    n: int
    sums: np.ndarray  # Python integers
    components: np.ndarray  # a column each, unit length, largest entry positive
    values: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        centred = wv.minus(x, np.array([int(s) // self.n for s in self.sums], dtype=object)).astype(np.float64)
        centred -= np.array([int(s) % self.n / self.n for s in self.sums])
        return centred @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        fits = self.n * wv.largest(x) < 2**62 and wv.largest(self.sums) < 2**62
        return wv.square_sums(wv.minus(x * self.n if fits else x.astype(object) * self.n, self.sums))


def _sums(distinct: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, x in wv.matrices(batch.column(0)):
                row = np.concatenate([[len(at)], wv.column_sums(x)]).astype(object)
                total[x.shape[1]] = total.get(x.shape[1], 0) + row
        yield wv.partial_rows({(size, i, 0): v for size, row in total.items() for i, v in enumerate(row)})

    return distinct.mapInArrow(run, wv.PARTIAL)


def _scatter(distinct: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, x in wv.matrices(batch.column(0)):
                for lo in range(0, len(at), _ROWS):
                    y = wv.minus(x[lo : lo + _ROWS], centres[x.shape[1]])
                    total[x.shape[1]] = total.get(x.shape[1], 0) + wv.gram(y).astype(object)
        yield wv.partial_rows({(size, i, j): m[i, j] for size, m in total.items() for i in range(size) for j in range(i, size)})

    return distinct.mapInArrow(run, wv.PARTIAL)


def fit(distinct: DataFrame, keep: int = KEEP) -> dict[int, Model]:
    """A model per length of the vectors ``x`` (``array<long>``, each of them once)."""
    first = wv.added(_sums(distinct))
    counts = {size: n for (size, i, _), n in first.items() if i == 0 and size > 0}
    sums = {size: np.array([first.get((size, i + 1, 0), 0) for i in range(size)], dtype=object) for size in counts}
    centres = {size: np.array([(2 * int(s) + n) // (2 * n) for s in sums[size]], dtype=object) for size, n in counts.items()}
    second = wv.added(_scatter(distinct, centres))
    models = {}
    for size, n in counts.items():
        off = [int(s) - n * int(c) for s, c in zip(sums[size], centres[size])]
        covariance = np.zeros((size, size))
        for i in range(size):
            for j in range(i, size):
                # Whole numbers up to the one division: correctly rounded.
                covariance[i, j] = covariance[j, i] = (n * second.get((size, i, j), 0) - off[i] * off[j]) / (n * n)
        components, values = one_sided_jacobi(pivoted_cholesky(covariance))
        top = np.abs(components).argmax(axis=0)
        components = components * np.where(components[top, np.arange(len(values))] < 0, -1.0, 1.0)
        models[size] = Model(n, sums[size], components[:, :keep], values[:keep], float(np.trace(covariance)))
    return models


def _identity_errors(distinct: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Per length, the largest entry of the whitened vectors' covariance minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, x in wv.matrices(batch.column(0)):
                if x.shape[1] in models and len(models[x.shape[1]].values):
                    w = models[x.shape[1]].whitened(x)
                    total[x.shape[1]] = total.get(x.shape[1], 0) + np.vstack([w.sum(axis=0), w.T @ w])
        rows = [(size, i, j, float(v)) for size, m in total.items() for i, line in enumerate(m) for j, v in enumerate(line)]
        columns = list(zip(*rows)) if rows else [()] * 4
        kinds = [pa.int32()] * 3 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["size", "i", "j", "value"])

    sums = distinct.mapInArrow(run, "size int, i int, j int, value double").groupBy("size", "i", "j").agg(F.sum("value").alias("value"))
    found: dict[int, dict[tuple[int, int], float]] = {}
    for r in sums.collect():
        found.setdefault(r["size"], {})[r["i"], r["j"]] = r["value"]
    out = {}
    for size, m in found.items():
        n, k = models[size].n, len(models[size].values)
        mean = np.array([m[0, j] for j in range(k)]) / n
        square = np.array([[m[i + 1, j] for j in range(k)] for i in range(k)]) / n
        out[size] = float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = FACTOR, keep: int = KEEP) -> DataFrame:
    """One row per sound vector and component: ``id_col, component, n, deviation, whitened, explained, identity_error``.

    Rows whose vector is null or holds a null, NaN or infinity are dropped. Every entry becomes
    floor(factor * entry). The model is fitted on each distinct vector once and applied to every row; repeated rows and rows with
    a null id are returned each. Vectors of another length have a model of their own. There are as many components
    as directions with variance, ``keep`` at most: none, hence no rows, for empty vectors or for a single distinct one.
    ``deviation`` is null where it has more than 64 bits. Other columns, also of clashing names, are not returned.
    """
    vector = F.col(f"`{vector_col}`")
    rows = vectors.where(wv.finite(vector)).select(F.col(f"`{id_col}`").alias("id"), wv.lattice(vector, factor).alias("x"))
    distinct = stored(rows.where(F.size("x") > 0).select("x").distinct(), "distinct-vectors")
    models = fit(distinct, keep)
    errors = _identity_errors(distinct, models)
    kind = rows.schema["id"].dataType
    out = T.StructType(
        [T.StructField("id", kind), T.StructField("component", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("n", "deviation")]
        + [T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in wv.matrices(batch.column(1)):
                model = models.get(x.shape[1])
                if model is None or not len(model.values):
                    continue
                k, rows_here = len(model.values), len(at)
                each = np.repeat(np.arange(rows_here), k)
                columns = [
                    batch.column(0).take(pa.array(at[each])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_here)),
                    pa.array(np.full(rows_here * k, model.n, dtype=np.int64)),
                    wv.longs(model.deviations(x)).take(pa.array(each)),
                    pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(model.values / model.trace, rows_here)),
                    pa.array(np.full(rows_here * k, errors[x.shape[1]])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)
