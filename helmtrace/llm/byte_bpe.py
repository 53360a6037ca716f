"""Byte-level BPE with vectorised pre-tokenisation.

No regex runs over a text. Its code points become an array of classes; every class is a transition
function of a small automaton; the functions compose associatively, so an inclusive scan over the
composition table gives the state at every position and, with it, all token boundaries at once. Blocks
of texts are scanned together. The slices between boundaries are looked up in a bounded cache of
merged pieces, and merged only where they are new.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from helmtrace.llm.common import without

# Classes of code points. The last two are an apostrophe with one or two contraction letters after it.
LETTER, NUMBER, OTHER, SPACE, BLANK, SHORT, LONG = range(7)
# States: what the code point before a position was part of.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_BLANK, ONE_LEFT, TWO_LEFT = range(8)
# Code points with the Unicode property White_Space, beside U+0020.
BLANKS = [9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The letters of contractions that follow an apostrophe.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

BLOCK_CHARS = 1 << 18
CACHE_PIECES = 200_000
_SCAN = 64


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[BLANKS] = BLANK
    out[32] = SPACE
    return out


@lru_cache(maxsize=1)
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Composition table, the function of each class, and the state that each function leads to from FRESH."""
    letters = [IN_LETTERS] * 6 + [FRESH, ONE_LEFT]
    after = [letters, [IN_NUMBERS] * 8, [IN_OTHER] * 8, [AFTER_SPACE] * 8, [IN_BLANK] * 8]
    for left in (ONE_LEFT, TWO_LEFT):
        after.append([IN_OTHER if s in (IN_OTHER, AFTER_SPACE) else left for s in range(8)])
    functions = [tuple(range(8))]
    for f in map(tuple, after):
        if f not in functions:
            functions.append(f)
    at = 0
    while at < len(functions):  # close the set under composition
        for g in list(functions):
            for pair in ((functions[at], g), (g, functions[at])):
                both = tuple(pair[1][s] for s in pair[0])
                if both not in functions:
                    functions.append(both)
        at += 1
    number = {f: i for i, f in enumerate(functions)}
    table = np.array([[number[tuple(g[s] for s in f)] for g in functions] for f in functions], dtype=np.uint8)
    return table, np.array([number[tuple(f)] for f in after], dtype=np.uint8), np.array([f[FRESH] for f in functions], dtype=np.uint8)


def _scan(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Inclusive scan of function numbers: short runs side by side, then their totals, then both joined."""
    n = len(codes)
    if n <= _SCAN:
        out = codes.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], out[i]]
        return out
    rows = -(-n // _SCAN)
    grid = np.zeros(rows * _SCAN, dtype=np.uint8)
    grid[:n] = codes
    grid = np.ascontiguousarray(grid.reshape(rows, _SCAN).T)
    flat, width = table.ravel(), table.shape[1]
    for i in range(1, _SCAN):
        grid[i] = flat[grid[i - 1].astype(np.intp) * width + grid[i]]
    before = np.zeros(rows, dtype=np.uint8)  # function 0 is the identity
    before[1:] = _scan(grid[-1], table)[:-1]
    grid = flat[before.astype(np.intp)[None, :] * width + grid]
    return np.ascontiguousarray(grid.T).ravel()[:n]


def boundaries(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pieces start in ``points``, the joined code points of texts that start at ``firsts``."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    cls = _classes()[points]
    head = np.zeros(n + 1, dtype=bool)
    head[firsts[firsts < n]] = True
    head[n] = True
    marks = np.flatnonzero(points == 39)
    if len(marks):
        padded = np.concatenate((points, np.zeros(2, points.dtype)))
        one, two = padded[marks + 1], padded[marks + 2]
        inside1 = ~head[np.minimum(marks + 1, n)]
        inside2 = inside1 & ~head[np.minimum(marks + 2, n)]
        short = inside1 & np.isin(one, [ord(c) for c in ONE_LETTER])
        long = inside2 & np.any([(one == ord(a)) & (two == ord(b)) for a, b in TWO_LETTERS], axis=0)
        cls[marks[short]] = SHORT
        cls[marks[long]] = LONG
    table, of_class, leads = _automaton()
    # A text must not depend on the one before it: its first function starts anew, whatever came before.
    codes = of_class[cls]
    starts = np.flatnonzero(head[:n])
    anew = _restart(table, of_class)
    codes[starts] = anew[cls[starts]]
    state = np.empty(n, dtype=np.uint8)
    state[0] = FRESH
    state[1:] = leads[_scan(codes, table)[:-1]]
    state[starts] = FRESH
    blank = (cls == SPACE) | (cls == BLANK)
    start = _starts()[state.astype(np.intp) * 8 + cls]
    last = np.empty(n, dtype=bool)  # the last of a run of white space that something follows
    last[:-1] = blank[:-1] & ~blank[1:] & ~head[1:n]
    last[-1] = False
    return np.flatnonzero(start | last | head[:n])


@lru_cache(maxsize=1)
def _starts() -> np.ndarray:
    """Whether a code point of a class starts a piece, by state and class."""
    out = np.ones((8, 8), dtype=bool)
    out[[IN_LETTERS, AFTER_SPACE, ONE_LEFT, TWO_LEFT], LETTER] = False
    out[[IN_NUMBERS, AFTER_SPACE], NUMBER] = False
    for mark in (OTHER, SHORT, LONG):
        out[[IN_OTHER, AFTER_SPACE], mark] = False
    for gap in (SPACE, BLANK):
        out[[AFTER_SPACE, IN_BLANK], gap] = False
    return out.ravel()


def _restart(table: np.ndarray, of_class: np.ndarray) -> np.ndarray:
    """For each class the function that leads to the same state from everywhere, as after a fresh start."""
    leads = _automaton()[2]
    # A constant function composed with anything stays constant: a number resets, a letter after it does not matter.
    constant = {}
    for i in range(len(table)):
        if all(table[j, i] == i for j in range(len(table))):
            constant[int(leads[i])] = i
    return np.array([constant[int(leads[f])] for f in of_class], dtype=np.uint8)


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Bytes to id, of a file with a base64 piece and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}


@lru_cache(maxsize=4)
def load_pieces(path: str) -> list[bytes]:
    """Bytes of every id."""
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of the lowest rank is merged, leftmost first, until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > 400:
        return _merge_long(parts, ranks)
    none = len(ranks) + 1
    cost = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while cost:
        low = min(cost)
        if low == none:
            break
        i = cost.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del cost[i]
        if i < len(cost):
            cost[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            cost[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same for long pieces, with a heap over a linked list: n log n instead of n squared."""
    import heapq

    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or parts[i] != left or parts[j] != right:
            continue
        parts[i] = left + right
        alive[j] = False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a], parts[b]))
    return [ranks[parts[i]] for i in range(n) if alive[i]]


class _Merged(dict):
    """Piece to its ids as little-endian 32-bit bytes; starts anew when it is full."""

    def __init__(self, ranks: dict[bytes, int], most: int = CACHE_PIECES):
        self.ranks, self.most = ranks, most

    def __missing__(self, piece: bytes) -> bytes:
        ids = np.array(merge(piece, self.ranks), dtype="<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def _merged(path: str) -> _Merged:
    return _Merged(load_ranks(path))


@lru_cache(maxsize=2)
def piece_lengths(path: str) -> np.ndarray:
    """Length in bytes of every id."""
    return np.array([len(p) for p in load_pieces(path)], dtype=np.int64)


def encode_block(texts: list[str], path: str) -> list[bytes]:
    """Ids of every text, as little-endian unsigned 32-bit integers."""
    joined = "".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    firsts = np.concatenate(([0], np.cumsum(sizes)))
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    starts = boundaries(points, firsts[:-1])
    width = np.ones(len(points) + 1, dtype=np.int64)
    width[:-1] += (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    offset = np.concatenate(([0], np.cumsum(width[:-1])))
    data = joined.encode("utf-8")
    cuts = offset[starts].tolist()
    cuts.append(len(data))
    merged = _merged(path)
    pieces = [merged[data[a:b]] for a, b in zip(cuts, cuts[1:])]
    owner = np.searchsorted(starts, firsts).tolist()
    return [b"".join(pieces[a:b]) for a, b in zip(owner, owner[1:])]


def encode_texts(texts: list[str], path: str, block_chars: int = BLOCK_CHARS) -> list[bytes]:
    """``encode_block`` over blocks of about ``block_chars`` code points; a longer text is a block of its own."""
    out: list[bytes] = []
    block: list[str] = []
    held = 0
    for text in texts:
        if block and held + len(text) > block_chars:
            out += encode_block(block, path)
            block, held = [], 0
        block.append(text)
        held += len(text)
    return out + (encode_block(block, path) if block else [])


def decode_ids(ids: bytes, path: str) -> bytes:
    """The bytes that ids stand for."""
    return b"".join(map(load_pieces(path).__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def token_ends(ids: bytes, path: str) -> np.ndarray:
    """Byte offset after each token, within the UTF-8 text."""
    return np.cumsum(piece_lengths(path)[np.frombuffer(ids, dtype="<u4")])


#: Rows that a task encodes or decodes at once; what it holds is these and the batch they came in.
ROWS_AT_ONCE = 128


def _starts_of(ids: bytes, path: str) -> bytes:
    ends = token_ends(ids, path)
    return np.concatenate(([0], ends))[:-1].astype("<u4").tobytes() if len(ends) else b""


def _binary(name: str) -> T.StructField:
    return T.StructField(name, T.BinaryType())


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_ids`` (ids) and ``_offsets`` (the byte offset of every token's start), little-endian 32-bit.

    Null texts are empty: no ids. No row is dropped. Columns of ``docs`` with these names are replaced; the others
    stay as they are. ``path`` names the ranks file, which every executor must have.
    """
    docs = without(docs, "_ids", "_offsets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                ids = encode_texts([t or "" for t in part.column(text_col).to_pylist()], path)
                starts = [_starts_of(i, path) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(ids, pa.binary()), pa.array(starts, pa.binary())], [*part.schema.names, "_ids", "_offsets"]
                )

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, _binary("_ids"), _binary("_offsets")]))


def decode(coded: DataFrame, path: str, ids_col: str = "_ids") -> DataFrame:
    """``coded`` with the decoded bytes of ``ids_col`` in ``_decoded``; null ids decode to nothing."""
    coded = without(coded, "_decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                found = [decode_ids(i or b"", path) for i in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*part.schema.names, "_decoded"])

    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, _binary("_decoded")]))
