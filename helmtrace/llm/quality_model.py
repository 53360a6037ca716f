"""Quality classifier: histogram gradient-boosted trees over document statistics, in numpy.

Statistics of a whole text are binned by quantiles; trees grow level by level on histograms of
gradients; the grown trees are flattened into arrays (feature, bin, children, value) that are walked for a
whole batch at once. Learning uses a bounded sample of labelled rows (``sample_rows``), drawn by the
hash of the id; statistics and scores cover every row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helmtrace.llm.common import whole

SAMPLE_ROWS = 12_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF, L2 = 60, 4, 0.15, 64, 20, 1.0
HELD_OUT, FOLDS = 1, 3

FEATURES = (
    "log_chars log_words word_chars long_words upper_share digit_share mark_share symbol_share pipe_share bang_share "
    "space_share line_share lines_repeated capital_words upper_words distinct_words top_word repeated_next repeated_pair "
    "word_spread ends_marked symbol_words letter_words newline_chars"
).split()


def document_statistics(text: str | None) -> np.ndarray:
    """One row of ``FEATURES``; null and empty texts have all zeros."""
    out = np.zeros(len(FEATURES))
    text = text or ""
    words = text.split()
    if not words:
        out[0] = np.log1p(len(text))
        return out
    data = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    n = len(data)
    low = np.bincount(np.minimum(data, 128), minlength=129)
    upper = int(low[65:91].sum())
    symbols = int(low[[35, 42, 36, 37, 38, 124, 60, 62, 64, 94, 126, 95, 61, 92]].sum())
    marks = int(low[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum())
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = pd.factorize(np.array(words, dtype=object))[0]
    counts = np.bincount(codes)
    m = len(words)
    pairs = codes[:-1].astype(np.int64) * len(counts) + codes[1:]
    lines = [line for line in text.split("\n") if line.strip()]
    capital = sum(w[0].isupper() for w in words)
    shouted = sum(w.isupper() for w in words)
    marked = sum(w[-1] in ".,;:!?" for w in words)
    odd = sum(not w[-1].isalnum() and w[-1] not in ".,;:!?\"')" for w in words)
    plain = sum(w.isalpha() for w in words)
    out[:] = (
        np.log1p(n), np.log1p(m), lengths.mean(), (lengths > 15).mean(), upper / n, low[48:58].sum() / n, marks / n, symbols / n,
        low[124] / n, low[33] / n, low[32] / n, len(lines) / m, 1 - len(set(lines)) / max(1, len(lines)), capital / m, shouted / m,
        len(counts) / m, counts.max() / m, (codes[1:] == codes[:-1]).sum() / m, 1 - len(np.unique(pairs)) / max(1, len(pairs)),
        lengths.std(), marked / m, odd / m, plain / m, low[10] / n,
    )
    return out


def statistics_column(text: Column) -> Column:
    """``document_statistics`` of a column, as an array of doubles."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([document_statistics(t) for t in texts], index=texts.index)

    return run(text)


@dataclass
class Forest:
    """Trees in flat arrays: node ``i`` sends a row left if ``bin <= cut``; leaves point at themselves."""

    edges: np.ndarray  # features x (bins - 1), upper edges of the bins
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def bins(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, rows[:, f], side="left") for f, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def margin(self, rows: np.ndarray) -> np.ndarray:
        """Log odds of label 1: all trees are walked together, one level at a time."""
        binned = self.bins(rows)
        at = np.broadcast_to(self.roots, (len(rows), len(self.roots))).copy()
        pick = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            goes_left = binned[pick, self.feature[at]] <= self.cut[at]
            at = np.where(goes_left, self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(rows)))


def grow(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Forest:
    """Logistic boosting on histograms. No rows, or one label only, gives a forest of the smoothed share alone."""
    share = (labels.sum() + 1) / (len(labels) + 2)
    base = float(np.log(share / (1 - share)))
    quantiles = np.linspace(0, 1, bins + 1)[1:-1]
    edges = np.quantile(rows, quantiles, axis=0).T if len(rows) else np.zeros((len(FEATURES), bins - 1))
    forest = Forest(edges, *(np.zeros(0, int) for _ in range(4)), np.zeros(0), np.zeros(0, int), base, depth)
    binned = forest.bins(rows) if len(rows) else np.zeros((0, len(FEATURES)), np.uint8)
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    margin = np.full(len(rows), base)
    width = binned.shape[1]

    def node() -> int:
        me = len(feature)
        feature.append(0), cut.append(bins), left.append(me), right.append(me), value.append(0.0)
        return me

    for _ in range(trees if len(rows) and 0 < labels.sum() < len(labels) else 0):
        chance = 1 / (1 + np.exp(-margin))
        gradient, weight = labels - chance, chance * (1 - chance)
        root = node()
        roots.append(root)
        level = [(root, np.arange(len(rows)))]
        for at in range(depth + 1):
            below = []
            for me, mine in level:
                g, h = gradient[mine].sum(), weight[mine].sum()
                value[me] = rate * g / (h + L2)
                if at == depth or len(mine) < 2 * LEAST_LEAF:
                    continue
                flat = (binned[mine] + np.arange(width) * bins).ravel()
                sums = [np.bincount(flat, np.repeat(x, width), width * bins).reshape(width, bins) for x in (gradient[mine], weight[mine])]
                sums.append(np.bincount(flat, minlength=width * bins).reshape(width, bins))
                gl, hl, nl = (s.cumsum(axis=1)[:, :-1] for s in sums)
                gain = gl**2 / (hl + L2) + (g - gl) ** 2 / (h - hl + L2) - g**2 / (h + L2)
                gain[(nl < LEAST_LEAF) | (len(mine) - nl < LEAST_LEAF)] = -1
                best = int(gain.argmax())
                if gain.flat[best] <= 1e-6:
                    continue
                f, c = divmod(best, bins - 1)
                goes_left = binned[mine, f] <= c
                feature[me], cut[me], left[me], right[me] = f, c, node(), node()
                below += [(left[me], mine[goes_left]), (right[me], mine[~goes_left])]
            level = below
        at_leaf = np.full(len(rows), root)
        for _ in range(depth):
            f, c = np.array(feature)[at_leaf], np.array(cut)[at_leaf]
            goes_left = binned[np.arange(len(rows)), f] <= c
            at_leaf = np.where(goes_left, np.array(left)[at_leaf], np.array(right)[at_leaf])
        margin += np.array(value)[at_leaf]
    ints = [np.array(x, dtype=np.int64) for x in (feature, cut, left, right)]
    return Forest(edges, *ints, np.array(value), np.array(roots, dtype=np.int64), base, depth)


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo ``FOLDS``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> Forest:
    """Learns from at most ``sample_rows`` labelled rows whose fold is not held out.

    The sample goes by the hash of the id, so it does not depend on order or partitions. Null ids and
    null labels are left out. Of repeated rows of an id one is learned from. Without usable rows every text gets the score 0.5.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col) != HELD_OUT))
    chosen = (
        usable.groupBy(F.col(id_col).alias("_chosen"))
        .agg(F.max(F.col(label_col)).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_chosen"), "_chosen")
        .limit(sample_rows)
    )
    # At most sample_rows rows of two numbers: small enough to broadcast, by the parameter.
    texts = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text")).join(
        F.broadcast(chosen), F.col("_id") == F.col("_chosen")
    )
    learned = texts.select("_id", "_label", statistics_column(F.col("_text")).alias("row"), F.crc32(F.col("_text").cast("binary")).alias("_tie"))
    # One row per chosen id, whatever its repeated rows hold: that with the smallest hash.
    one = learned.groupBy("_id").agg(F.min(F.struct("_tie", "_label", "row")).alias("row")).select("_id", "row._label", "row.row")
    found = one.toPandas().sort_values("_id")
    rows = np.array(found["row"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return grow(rows, found["_label"].to_numpy(dtype=np.float64))


def score_column(text: Column, forest: Forest) -> Column:
    """The score of every text, 0 to 1; the forest travels with the function (some tens of KB)."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = np.array([document_statistics(t) for t in texts]).reshape(-1, len(FEATURES))
            yield pd.Series(np.concatenate([forest.score(rows[i : i + 4096]) for i in range(0, max(1, len(rows)), 4096)]), index=texts.index)

    return run(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``_score``: how likely label 1 is. Null texts score as empty ones; no row is dropped.

    A column ``_score`` of ``docs`` is replaced.
    """
    forest = fit(docs, labels, id_col, text_col, label_col, sample_rows)
    return docs.withColumn("_score", score_column(whole(text_col), forest))


def crc_of(value: object) -> int:
    """The fold's hash outside Spark, for tests."""
    return zlib.crc32(str(value).encode())
