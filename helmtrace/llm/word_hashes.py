"""Hashes of the words of whole texts and of runs of words, on bytes and in numpy.

A block of bytes is cut into words by a table of 256 entries. A word's hash is a sum of its bytes times odd random weights by
place, mixed; a run's hash is the same over its words' hashes. Both are universal 64-bit hashes: where equality must be certain,
callers compare the words.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_BLOCK = 1 << 20
_SPREAD = 4_096
_rng = np.random.default_rng(12)
_BYTE_WEIGHTS = _rng.integers(0, 1 << 63, _SPREAD, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_WEIGHTS = _rng.integers(0, 1 << 63, _SPREAD, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_codes = np.arange(256, dtype=np.uint8)
#: A-Z in lower case.
LOWER = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
#: Bytes of words of letters, digits and characters beyond ASCII.
ALPHANUMERIC = (_codes >= 128) | ((LOWER >= 97) & (LOWER <= 122)) | ((_codes >= 48) & (_codes <= 57))
#: Bytes of words between white space (U+0020, U+0009 to U+000D).
NOT_WHITE = (_codes != 32) & ((_codes < 9) | (_codes > 13))


class Words(NamedTuple):
    """The words of a block of bytes: where they start and end, and their hashes."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray


def words_of(block: np.ndarray, in_word: np.ndarray = ALPHANUMERIC) -> Words:
    """The words of a block, A-Z in lower case; hashed by at most ``_BLOCK`` bytes at a time (or one longer word)."""
    inside = np.zeros(len(block) + 2, dtype=bool)
    inside[1:-1] = in_word[block]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    hashes = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + _BLOCK)))
        part = slice(int(starts[lo]), int(ends[hi - 1]))
        letters = LOWER[block[part][inside[1:-1][part]]].astype(np.uint64) + np.uint64(1)
        lengths = ends[lo:hi] - starts[lo:hi]
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(letters)) - np.repeat(first, lengths)
        h = np.add.reduceat(letters * _BYTE_WEIGHTS[place % _SPREAD], first)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        hashes[lo:hi] = h ^ (h >> np.uint64(29))
        lo = hi
    return Words(starts, ends, hashes)


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of every ``length`` consecutive words."""
    count = len(hashes) - length + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    for k in range(length):
        total += hashes[k : k + count] * _WORD_WEIGHTS[k % _SPREAD]
    return total ^ (total >> np.uint64(31))
