"""Benchmark decontamination by a broadcast hash set of the benchmark's normalised n-grams.

Texts are lower-cased (A-Z) and cut into words of letters, digits and characters beyond ASCII. A benchmark text gives a window
for every ``n`` consecutive words, a shorter one a single window. A task hashes the words of whole documents on their
bytes and the windows from the word hashes, in numpy; positions whose window hash is in the set are verified on the words
themselves. What comes out are the words inside occurrences, as spans of the text, and the benchmark items they come from.

The set is broadcast if its measured size is at most ``BROADCAST_BYTES``. Beyond that the documents' window hashes
are joined with the set's, and each text is verified against the windows that met it: the same results.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helmtrace.llm.common import stored, whole, without
from helmtrace.llm.word_hashes import LOWER, Words, window_hashes, words_of

WINDOW = 10
BROADCAST_BYTES = 32 << 20
# What ends a word, after A-Z have been lower-cased.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLOCK = 1 << 20


class Index:
    """Windows by length, their hashes sorted behind a table of the hashes' first bits, and the items of each."""

    def __init__(self, entries: list[tuple[str, list[str]]]):
        self.items = {window.encode("utf-8"): items for window, items in entries}
        self.hashes: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        by_length: dict[int, list[int]] = {}
        for window in self.items:
            found = words_of(np.frombuffer(window, np.uint8)).hashes
            by_length.setdefault(len(found), []).append(int(window_hashes(found, len(found))[0]))
        for length, values in by_length.items():
            sorted_hashes = np.unique(np.array(values, dtype=np.uint64))
            bits = min(24, max(10, len(sorted_hashes).bit_length() + 4))
            table = np.zeros(1 << bits, dtype=bool)
            table[sorted_hashes >> np.uint64(64 - bits)] = True
            self.hashes[length] = sorted_hashes, table, 64 - bits

    def candidates(self, words: Words) -> Iterator[tuple[int, np.ndarray]]:
        """Per length, the numbers of the words where a window with a known hash starts."""
        for length, (known, table, shift) in self.hashes.items():
            h = window_hashes(words.hashes, length)
            at = np.flatnonzero(table[h >> np.uint64(shift)])
            spot = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
            yield length, at[known[spot] == h[at]]


class Found(NamedTuple):
    """Of one text: its words, the words hit, the spans of bytes they cover, and the items."""

    n_words: int
    n_hit: int
    spans: list[tuple[int, int]]
    items: list[str]


def scan(texts: list[bytes], index: Index) -> list[Found]:
    """What of the benchmark each text holds."""
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    block = np.frombuffer(b"\n".join(texts), np.uint8)
    words = words_of(block)
    owner = np.searchsorted(offsets, words.starts, side="right") - 1
    counts = np.bincount(owner, minlength=len(texts))
    hit = np.zeros(len(words.starts) + 1, dtype=np.int64)
    items: dict[int, set[str]] = {}
    for length, at in index.candidates(words):
        for k in at[owner[at] == owner[at + length - 1]].tolist():
            window = b" ".join(LOWER[block[s:e]].tobytes() for s, e in zip(words.starts[k : k + length], words.ends[k : k + length]))
            named = index.items.get(window)
            if named is not None:
                hit[k] += 1
                hit[k + length] -= 1
                items.setdefault(int(owner[k]), set()).update(named)
    marked = np.cumsum(hit)[:-1] > 0
    hits = np.bincount(owner[marked], minlength=len(texts))
    spans: dict[int, list[tuple[int, int]]] = {}
    at = np.flatnonzero(marked)
    if len(at):
        new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(owner[at]) > 0)])
        first, last = at[new], at[np.concatenate([new[1:], [True]])]
        for a, b in zip(first.tolist(), last.tolist()):
            top = int(offsets[owner[a]])
            spans.setdefault(int(owner[a]), []).append((int(words.starts[a]) - top, int(words.ends[b]) - top))
    return [Found(int(counts[i]), int(hits[i]), spans.get(i, []), sorted(items.get(i, ()))) for i in range(len(texts))]


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Neighbouring texts of about ``_BLOCK`` bytes together; a longer text alone."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > _BLOCK:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *[e for _, e in spans]]
    starts = [*[s for s, _ in spans], len(text)]
    return b"".join(text[e:s] for e, s in zip(ends, starts))


_FOUND = "struct<n_words: long, n_hit: long, spans: array<struct<start: int, end: int>>, items: array<string>, clean: string>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _told(texts: list[bytes], found: list[Found]) -> pa.StructArray:
    """The results of a batch; spans in code points; the text without its spans only where it has any."""
    spans, clean = [], []
    for text, f in zip(texts, found):
        if f.spans:
            begins = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
            spans.append([{"start": int(begins[s]), "end": int(begins[e])} for s, e in f.spans])
        else:
            spans.append([])
        clean.append(_without_spans(text, f.spans).decode("utf-8", "replace") if f.spans else None)
    columns = [
        pa.array([f.n_words for f in found], pa.int64()),
        pa.array([f.n_hit for f in found], pa.int64()),
        pa.array(spans, _SPANS),
        pa.array([f.items for f in found], pa.list_(pa.string())),
        pa.array(clean, pa.string()),
    ]
    return pa.StructArray.from_arrays(columns, names=["n_words", "n_hit", "spans", "items", "clean"])


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = WINDOW) -> DataFrame:
    """Every distinct window of the benchmark: ``window`` (words joined by a space) and ``items``, its ids as sorted strings."""
    cut = F.split(F.regexp_replace(F.translate(whole(f"`{text_col}`"), _UPPER, _UPPER.lower()), NO_WORD, " "), " ")
    words = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.filter(cut, lambda w: w != "").alias("words"))
    words = words.where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1)))
    each = words.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, n), " "))).alias("window"))
    return each.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _scan_column(text: Column, index) -> Column:
    @F.arrow_udf(_FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            texts = column.cast(pa.binary()).to_pylist()
            yield _told(texts, [f for block in _blocks(texts) for f in scan(block, index.value)])

    return run(text)


def _hashes_column(text: Column, lengths: list[int]) -> Column:
    """All distinct window hashes of a text."""

    @F.arrow_udf("array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = []
            for t in column.cast(pa.binary()).to_pylist():
                h = words_of(np.frombuffer(t, np.uint8)).hashes
                out.append(np.unique(np.concatenate([window_hashes(h, k) for k in lengths])).view(np.int64))
            yield pa.array(out, pa.list_(pa.int64()))

    return run(text)


def _rescan_column(text: Column, met: Column) -> Column:
    @F.arrow_udf(_FOUND)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, known in batches:
            texts = column.cast(pa.binary()).to_pylist()
            entries = [[(e["window"], e["items"]) for e in some or []] for some in known.to_pylist()]
            yield _told(texts, [scan([t], Index(e))[0] for t, e in zip(texts, entries)])

    return run(text, met)


def _by_join(docs: DataFrame, known: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``_found`` for a benchmark of any size: texts meet windows by hash in a shuffle."""
    lengths = [r["k"] for r in known.select(F.size(F.split("window", " ")).alias("k")).distinct().collect()]  # 1 to n
    hashed = known.withColumn("hash", F.explode(_hashes_column(F.col("window"), lengths)))
    held = docs.select(F.sha2(text, 256).alias("_key"), F.explode(_hashes_column(text, lengths)).alias("hash"))
    met = held.join(hashed.select("hash").distinct(), "hash").distinct()
    met = met.join(hashed, "hash").groupBy("_key").agg(F.collect_set(F.struct("window", "items")).alias("_met"))
    keyed = docs.withColumn("_key", F.sha2(text, 256)).join(met, "_key", "left")
    return keyed.withColumn("_found", _rescan_column(text, F.col("_met"))).drop("_key", "_met")


def find(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    n: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` with ``_n_words``, ``_n_hit``, ``_spans``, ``_items`` and ``_clean``.

    A word is hit if it lies inside an occurrence of a benchmark window. ``_spans`` are the runs of hit words, in code points, end
    exclusive; ``_items`` the sorted ids, as strings, of the items with a window in the text; ``_clean`` the text without
    its spans. A null or empty text, or one without words, has no words and no hits; neither has a benchmark text without words any
    window. A benchmark row with a null id hits but is not listed. Repeated items count once. Every row of ``docs`` is
    returned; columns of these names (and ``_found``, ``_key``, ``_met``) are replaced.
    """
    docs = without(docs, "_n_words", "_n_hit", "_spans", "_items", "_clean", "_found", "_key", "_met")
    known = stored(windows(benchmark, item_col, item_text_col, n), "benchmark-windows")
    text = whole(f"`{text_col}`")
    weight = F.octet_length("window") + F.lit(200) + F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + F.octet_length(i) + 60)
    measured = known.agg(F.sum(weight)).first()[0] or 0
    if measured <= broadcast_bytes:
        index = docs.sparkSession.sparkContext.broadcast(Index([(r["window"], r["items"]) for r in known.collect()]))
        found = docs.withColumn("_found", _scan_column(text, index))
    else:
        found = _by_join(docs, known, text)
    own = [F.col(f"_found.{c}").alias(f"_{c}") for c in ("n_words", "n_hit", "spans", "items")]
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], *own, F.coalesce("_found.clean", text).alias("_clean"))


def remove(docs: DataFrame, benchmark: DataFrame, what: str = "spans", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the benchmark's passages: ``what`` is ``spans`` (cut from the texts) or ``documents`` (whole rows)."""
    if what not in ("spans", "documents"):
        raise ValueError("what is spans or documents")
    found = find(docs, benchmark, text_col, **options)
    if what == "documents":
        return found.where("_n_hit = 0").select(*[F.col(f"`{c}`") for c in docs.columns])
    text = F.col(f"`{text_col}`")
    cut = F.when(F.col("_n_hit") > 0, F.col("_clean")).otherwise(text).alias(text_col)
    return found.select(*[cut if c == text_col else F.col(f"`{c}`") for c in docs.columns])
