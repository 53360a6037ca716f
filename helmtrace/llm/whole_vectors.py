"""Vectors of whole numbers: rounding, Arrow batches, and sums that never round.

Sums of any size leave a task as signed limbs of 60 bits, are added by Spark as decimals, and are put
together again on the driver, so they depend neither on partitions nor on their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMB = 60
#: Schema of partial sums: one value per group and position, in limbs.
PARTIAL = "key int, i int, j int, power int, value long"
LARGEST = 2**63 - 1


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither a null nor a value that is not finite."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


def lattice(vector: Column, factor: int) -> Column:
    """Every entry c as floor(factor * c), c as a double; what leaves 64 bits becomes the nearest long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(factor))).cast("long"))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and the matrix of the vectors of each length in a batch of ``array<long>``."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        some = column if len(at) == len(sizes) else column.take(pa.array(at))
        yield at, some.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(at), int(size))


def largest(*arrays: np.ndarray) -> int:
    """The largest absolute value, as a whole number of any size."""
    return max((max(int(a.max()), -int(a.min())) for a in arrays if a.size), default=0)


def minus(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """``x - centre`` exactly; Python integers where 64 bits do not suffice."""
    fits = largest(x, centre) < 2**62
    return x - centre.astype(np.int64) if fits else x.astype(object) - centre.astype(object)


def gram(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` exactly: in doubles while every sum stays below 2**53, else in Python integers."""
    if y.dtype != object and largest(y) ** 2 * len(y) < 2**53:
        f = y.astype(np.float64)
        return np.rint(f.T @ f).astype(np.int64)
    o = y.astype(object)
    return o.T @ o


def column_sums(y: np.ndarray) -> np.ndarray:
    """Sums of the columns, exactly."""
    return (y if y.dtype != object and largest(y) * len(y) < 2**62 else y.astype(object)).sum(axis=0)


def square_sums(y: np.ndarray) -> np.ndarray:
    """The sum of squares of every row, exactly."""
    if y.dtype != object and largest(y) ** 2 * max(1, y.shape[1]) < 2**62:
        return (y * y).sum(axis=1)
    o = y.astype(object)
    return (o * o).sum(axis=1)


def longs(values: np.ndarray) -> pa.Array:
    """Whole numbers as longs; null where a number has more than 64 bits."""
    if values.dtype != object:
        return pa.array(values.astype(np.int64))
    return pa.array([int(v) if abs(int(v)) <= LARGEST else None for v in values], pa.int64())


def partial_rows(sums: dict[tuple[int, int, int], int]) -> pa.RecordBatch:
    """Sums by ``key, i, j`` as a batch of ``PARTIAL``; zeros are left out."""
    rows = []
    for where, value in sums.items():
        sign, rest, power = (-1 if value < 0 else 1), abs(int(value)), 0
        while rest:
            rows.append((*where, power, sign * (rest & (1 << LIMB) - 1)))
            rest >>= LIMB
            power += 1
    columns = list(zip(*rows)) if rows else [()] * 5
    kinds = [pa.int32()] * 4 + [pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "i", "j", "power", "value"])


def added(partials: DataFrame) -> dict[tuple[int, int, int], int]:
    """The sums of all tasks by ``key, i, j``. Their number goes with the width of the vectors, not with the rows."""
    total = partials.groupBy("key", "i", "j", "power").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out: dict[tuple[int, int, int], int] = {}
    for r in total.collect():
        where = (r["key"], r["i"], r["j"])
        out[where] = out.get(where, 0) + (int(r["value"]) << LIMB * r["power"])
    return out
