"""Packing token sequences by harmonic classes.

With capacity ``C``, class ``j`` holds the pieces longer than ``C/(j+1)`` and at most ``C/j``: exactly
``j`` of them fill a sequence, whatever their lengths. Each worker fills the open sequence of each class
from its own stream of documents, so nothing is shuffled and nothing is counted globally. A document's
tail whose class would waste more than ``WASTE`` of a sequence is cut at a reciprocal of the capacity,
where it wastes nothing. What a worker holds at the end (at most one open sequence per class) is cut into
full sequences, and the last rest into powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helmtrace.llm.common import whole
from helmtrace.llm.word_hashes import LOWER, NOT_WHITE, words_of

CAPACITY = 2048
END_ID = 1
WASTE = 1 / 32
#: The last class takes all shorter pieces and closes a sequence when the next one does not fit.
CLASSES = 64
CACHE_WORDS = 300_000

Piece = tuple[int, int, bytes, int]  # document, start, ids (little-endian 32-bit), tokens of the document


# Letters and digits up to U+00FF (lower case), in the pattern by which the tokenizer splits words.
_LETTERS, _DIGITS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
_PARTS = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\n{_LETTERS}{_DIGITS}]+")
#: Blocks of so many bytes of text are encoded at once.
_BLOCK = 1 << 19


class _Kept(dict):
    """A bounded cache of two generations: when it is full it becomes the old one, and what is used again moves up."""

    def __init__(self, most: int):
        self.most, self.old = most, {}

    def missing(self, keys: set) -> list:
        """Of keys that this generation lacks, those that the old one lacks too; the others are in this one afterwards."""
        if len(self) + len(keys) > self.most:
            self.old = dict(self)
            self.clear()
        new = []
        for k in keys:
            if k in self.old:
                self[k] = self.old[k]
            else:
                new.append(k)
        return new

    def all_of(self, keys: list, learn) -> list:
        """The values of ``keys``; ``learn`` adds those of a list of missing ones."""
        values = list(map(self.get, keys))
        late = [i for i, v in enumerate(values) if v is None]
        if late:
            learn(self.missing({keys[i] for i in late}))
            for i in late:
                values[i] = self[keys[i]]
        return values


class Words:
    """Ids of whole texts, word by word: the tokenizer drops white space and never looks across it.

    The distinct words of a block are found by their hashes (and compared, byte for byte). Words of characters up to U+00FF are
    split into the tokenizer's own parts, which repeat far more often than words do, and parts are cached. Words with
    other characters, and those that hold a special token, go through the whole tokenizer as they are.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self.parts, self.others = path, _Kept(most), _Kept(most)
        self.merger = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.merger.get_added_tokens_decoder().values()]
        # The same vocabulary and merges for lines that are lower-case parts already.
        self.merger.normalizer = None
        whole_lines = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), whole_lines])

    @cached_property
    def tokenizer(self):
        """The tokenizer as it is; loaded only where a word needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of every text, as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = []
        held, size = [], 0
        for text in texts:
            if held and size + len(text) > _BLOCK:
                out += self._block(held)
                held, size = [], 0
            held.append(text)
            size += len(text)
        return out + self._block(held) if held else out

    def _block(self, texts: list[bytes]) -> list[bytes]:
        block = np.frombuffer(b"\n".join(texts), np.uint8)
        words = words_of(block, NOT_WHITE)
        if not len(words.starts):
            return [b""] * len(texts)
        lengths = words.ends - words.starts
        low = LOWER[block]
        # Words with a special token stay apart: their case counts.
        odd = np.zeros(len(words.starts), dtype=bool)
        joined = block.tobytes()
        for token in self.special:
            at = joined.find(token)
            while at >= 0:
                odd[np.searchsorted(words.starts, at, side="right") - 1] = True
                at = joined.find(token, at + 1)
        names = np.where(odd, ~words.hashes, words.hashes)
        _, first, number = np.unique(names, return_index=True, return_inverse=True)
        if not self._same(low, words.starts, lengths, first[number]):
            first, number = np.arange(len(names)), np.arange(len(names))
        starts, sizes = words.starts[first], lengths[first]
        # Beyond U+00FF, or the two white-space characters between U+0080 and U+00FF.
        wide = np.concatenate([[0], np.cumsum(block >= 0xC4)])
        white = np.concatenate([[0], np.cumsum((block[:-1] == 0xC2) & ((block[1:] == 0x85) | (block[1:] == 0xA0))), [0]])
        slow = odd[first] | (wide[starts + sizes] > wide[starts]) | (white[starts + sizes - 1] > white[starts])
        ids: list[bytes] = [b""] * len(first)
        counts = np.zeros(len(first), dtype=np.int64)
        quick = np.flatnonzero(~slow)
        parts = self._quick(low, starts[quick], sizes[quick])
        part_counts = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        # Only the end of a word has no ids.
        ended = np.cumsum(part_counts)[part_counts == 0]
        counts[quick] = np.diff(ended, prepend=0)
        late = np.flatnonzero(slow)
        for w, found in zip(late.tolist(), self._slow([joined[s : s + n] for s, n in zip(starts[late].tolist(), sizes[late].tolist())])):
            ids[w] = found
            counts[w] = len(found) >> 2
        # All ids of the distinct words, quick ones first, and where each word's begin.
        pool = np.frombuffer(b"".join(parts) + b"".join(ids[w] for w in late.tolist()), "<u4")
        begin = np.zeros(len(first), dtype=np.int64)
        order = np.concatenate([quick, late])
        begin[order] = np.cumsum(counts[order]) - counts[order]
        each = counts[number]
        ends = np.cumsum(each)
        flat = pool[np.arange(ends[-1]) + np.repeat(begin[number] - (ends - each), each)]
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        cuts = np.concatenate([[0], ends])[np.searchsorted(words.starts, offsets)]
        raw = flat.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    @staticmethod
    def _same(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> bool:
        """Whether every word equals the first one with its hash."""
        if (lengths != lengths[first]).any():
            return False
        place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return bool((low[np.repeat(starts, lengths) + place] == low[np.repeat(starts[first], lengths) + place]).all())

    def _quick(self, low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Ids of all parts of the given words, in order; empty ones after each word."""
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        text = np.full(int(sizes.sum()) + len(sizes), 10, dtype=np.uint8)
        ends = np.cumsum(sizes + 1) - 1
        text[np.repeat(ends - sizes, sizes) + place] = low[np.repeat(starts, sizes) + place]
        found = _PARTS.findall(text.tobytes().decode("utf-8", "replace").lower())
        return self.parts.all_of(found, self._merge)

    def _merge(self, parts: list[str]) -> None:
        """Encodes parts, thousands in one call; the end of a word has no ids."""
        if "\n" in parts:
            self.parts["\n"] = b""
            parts.remove("\n")
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            found = self.merger.encode("\n".join(some), add_special_tokens=False)
            raw = np.array(found.ids, dtype="<u4").tobytes()
            ends = 4 * np.cumsum(np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(some)))
            start = 0
            for part, end in zip(some, ends.tolist()):
                self.parts[part] = raw[start:end]
                start = end

    def _slow(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that the tokenizer has to see as they are."""

        def learn(new: list[bytes]) -> None:
            for word in new:
                ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
                self.others[word] = struct.pack(f"<{len(ids)}I", *ids)

        return self.others.all_of(words, learn)


@lru_cache(maxsize=2)
def _words(path: str, most: int = CACHE_WORDS) -> Words:
    return Words(path, most)


def class_of(length: int, capacity: int = CAPACITY, classes: int = CLASSES) -> int:
    """The number of pieces of this length that fill a sequence, ``classes`` at most."""
    return min(classes, capacity // length)


def cut_lengths(tokens: int, capacity: int = CAPACITY, waste: float = WASTE, classes: int = CLASSES) -> list[int]:
    """Lengths of the pieces of a document: full sequences, then a tail cut until its class wastes little."""
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        j = class_of(rest, capacity, classes)
        head = rest
        if j < classes and capacity - j * rest > waste * capacity:
            head = min(rest, capacity // (j + 1))
        out.append(head)
        rest -= head
    return out


class Packer:
    """One worker's open sequences. ``add`` and ``close`` yield lists of pieces, each list a sequence."""

    def __init__(self, capacity: int = CAPACITY, waste: float = WASTE, classes: int = CLASSES):
        self.capacity, self.waste, self.classes = capacity, waste, classes
        self.open: dict[int, list[Piece]] = {}
        self.filled: dict[int, int] = {}

    def add(self, doc: int, ids: bytes) -> Iterator[list[Piece]]:
        """Cuts a document (its ids as bytes) and places its pieces."""
        tokens, start = len(ids) // 4, 0
        for length in cut_lengths(tokens, self.capacity, self.waste, self.classes):
            piece = (doc, start, ids[4 * start : 4 * (start + length)], tokens)
            start += length
            j = class_of(length, self.capacity, self.classes)
            if j == self.classes and self.filled.get(j, 0) + length > self.capacity:
                yield self.open.pop(j)
                self.filled[j] = 0
            self.open.setdefault(j, []).append(piece)
            self.filled[j] = self.filled.get(j, 0) + length
            if (j < self.classes and len(self.open[j]) == j) or self.filled[j] == self.capacity:
                yield self.open.pop(j)
                self.filled[j] = 0

    def close(self) -> Iterator[list[Piece]]:
        """Cuts what is open into full sequences, and the last rest into powers of two."""
        held = [piece for j in sorted(self.open) for piece in self.open[j]]
        left = sum(len(p[2]) // 4 for p in held)
        self.open, self.filled = {}, {}
        sequence: list[Piece] = []
        room = size = self._size(left)
        for doc, start, ids, tokens in held:
            while ids:
                take = min(room, len(ids) // 4)
                sequence.append((doc, start, ids[: 4 * take], tokens))
                start, ids, room = start + take, ids[4 * take :], room - take
                if not room:
                    yield sequence
                    left -= size
                    sequence = []
                    room = size = self._size(left)

    def _size(self, left: int) -> int:
        """The length of the next closing sequence: full, or the largest power of two that is left."""
        return self.capacity if left >= self.capacity else (1 << left.bit_length() - 1 if left else 0)


def _pieces_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    waste: float = WASTE,
    classes: int = CLASSES,
    with_ids: bool = True,
    cache_words: int = CACHE_WORDS,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its text's ids by the tokenizer file ``path`` and then ``end_id``; null and empty texts
    are ``end_id`` alone. Special tokens in a text are one id each, as in the library's plain call. Every id lies in one piece.
    Repeated rows are packed each; a null id stays null.
    ``sequence_id`` is the partition number times 2**33 plus a count, so ``docs`` should be a stored table (or
    another input whose partitions a retried task sees again in the same order). A sequence is padded to
    ``capacity`` unless its length is a power of two; ids of a piece are little-endian unsigned 32-bit, left out
    without ``with_ids``. ``cache_words`` bounds a worker's memory and changes speed only. Other columns, also of clashing names, are not returned.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = _pieces_schema(docs.schema[id_col].dataType)
    if not with_ids:
        schema = T.StructType([f for f in schema if f.name != "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 33
        packer, words = Packer(capacity, waste, classes), _words(path, cache_words)
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist())):
                    for sequence in packer.add(doc, ids + end):
                        rows += _rows(sequence, number)
                        number += 1
                yield _batch(rows, kind, schema.names)
        rows = []
        for sequence in packer.close():
            rows += _rows(sequence, number)
            number += 1
        if rows:
            yield _batch(rows, kind, schema.names)

    return docs.select(F.col(f"`{id_col}`").alias("id"), whole(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(run, schema)


def _rows(sequence: list[Piece], number: int) -> list[tuple]:
    out, offset = [], 0
    for doc, start, ids, tokens in sequence:
        out.append((doc, start, len(ids) // 4, ids, zlib.crc32(ids), tokens, number, offset))
        offset += len(ids) // 4
    return out


def _batch(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    columns = dict(zip("doc_id start length ids ids_crc32 doc_tokens sequence_id offset".split(), list(zip(*rows)) or [()] * 8))
    kinds = {"doc_id": kind, "ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds.get(n, pa.int64())) for n in names], names=names)
