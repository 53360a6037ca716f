"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole. The character spans of its tokens are joined with the spans of
its sections: both are sorted, so a binary search finds the section of every token. A token that crosses a
section edge goes to the section that holds most of its characters, and to the earliest of equals; a
token that touches no section is counted as outside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helmtrace.llm.byte_bpe import ROWS_AT_ONCE, encode_texts, token_ends
from helmtrace.llm.common import whole, without

SECTION = T.StructType([T.StructField("name", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
COUNTED = T.StructType(
    [
        T.StructField("counts", T.ArrayType(T.IntegerType())),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_crossing", T.LongType()),
        T.StructField("n_outside", T.LongType()),
    ]
)
_SECTIONS = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_COUNTED = pa.struct([("counts", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("n_crossing", pa.int64()), ("n_outside", pa.int64())])


def line_sections(text: str | None) -> list[tuple[str, int, int]]:
    """The lines of a text, each with its line feed: ``title`` for the first, ``body`` for the others."""
    out, at = [], 0
    for i, line in enumerate((text or "").split("\n")):
        end = at + len(line) + 1
        out.append(("body" if i else "title", at, end))
        at = end
    return [*out[:-1], (out[-1][0], out[-1][1], len(text or ""))]


def token_spans(text: str, ids: bytes, path: str) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one code point that each token has bytes of."""
    ends = token_ends(ids, path)
    if not len(ends):
        return ends, ends
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    point = np.cumsum((data & 0xC0) != 0x80) - 1  # code point of every byte
    starts = np.concatenate(([0], ends[:-1]))
    return point[starts], point[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, sections: list[tuple[int, int]]) -> tuple[np.ndarray, int, int]:
    """Tokens per section, tokens that cross a section edge, and tokens outside; sections must not overlap.

    Sections may come in any order and may be empty (those get nothing).
    """
    counts = np.zeros(len(sections), dtype=np.int64)
    if not len(starts):
        return counts, 0, 0
    order = sorted((i for i, (a, b) in enumerate(sections) if b > a), key=lambda i: sections[i])
    lows = np.array([sections[i][0] for i in order], dtype=np.int64)
    highs = np.array([sections[i][1] for i in order], dtype=np.int64)
    if not order:
        return counts, 0, len(starts)
    first = np.searchsorted(highs, starts, side="right")  # the first section that ends after the token's start
    last = np.searchsorted(lows, ends, side="left") - 1  # the last section that starts before the token's end
    inner = np.minimum(first, len(order) - 1)
    inside = (first == last) & (lows[inner] <= starts) & (ends <= highs[inner])
    sums = np.bincount(first[inside], minlength=len(order)).astype(np.int64)
    crossing = outside = 0
    for t in np.flatnonzero(~inside):
        touched = range(first[t], last[t] + 1)
        if not touched:
            outside += 1
            continue
        crossing += 1
        overlap = [min(ends[t], highs[k]) - max(starts[t], lows[k]) for k in touched]
        sums[first[t] + int(np.argmax(overlap))] += 1
    counts[order] = sums
    return counts, crossing, outside


def _counted(text: str, ids: bytes, sections: list[dict] | None, path: str) -> dict:
    pairs = [(p["start"], p["end"]) if p and p["start"] is not None and p["end"] is not None else (0, 0) for p in sections or []]
    counts, crossing, outside = attribute(*token_spans(text, ids, path), pairs)
    return {"counts": counts, "n_tokens": len(ids) // 4, "n_crossing": crossing, "n_outside": outside}


def attribute_sections(docs: DataFrame, path: str, text_col: str = "text", sections_col: str | None = None) -> DataFrame:
    """``docs`` with ``_sections`` and ``_tokens``.

    ``sections_col`` names an array of ``name, start, end`` in code points; without it the lines are the sections.
    ``_tokens`` holds the tokens per section (``counts``, in the order of ``_sections``), of the whole text, those
    that cross an edge and those outside all sections. Null texts are empty, a null array has no section, and a
    section with a null start or end is empty. Columns of ``docs`` with these two names are replaced; no row is dropped.
    """
    given = docs.withColumn("_sections", F.col(sections_col)) if sections_col else without(docs, "_sections")
    given = without(given, "_tokens")
    kept = [c for c in given.columns if c != "_sections"]
    given = given.select(*[F.col(f"`{c}`") for c in kept], *([F.col("_sections").cast(T.ArrayType(SECTION)).alias("_sections")] if sections_col else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                if sections_col:
                    sections = part.column("_sections").to_pylist()
                else:
                    sections = [[dict(zip(SECTION.names, s)) for s in line_sections(t)] for t in texts]
                found = [_counted(t, i, s, path) for t, i, s in zip(texts, encode_texts(texts, path), sections)]
                own = [part.column(part.schema.names.index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sections, _SECTIONS), pa.array(found, _COUNTED)], [*kept, "_sections", "_tokens"])

    schema = T.StructType([*[given.schema[c] for c in kept], T.StructField("_sections", T.ArrayType(SECTION)), T.StructField("_tokens", COUNTED)])
    return given.mapInArrow(run, schema)


def field_sections(docs: DataFrame, fields: list[str], text_col: str = "_joined", sections_col: str = "_fields") -> DataFrame:
    """``docs`` with its text fields joined by line feeds, and the span of each (its line feed included); nulls are empty."""
    texts = [F.concat(whole(f), F.lit("\n" if i + 1 < len(fields) else "")) for i, f in enumerate(fields)]
    out, at = [], F.lit(0)
    for f, t in zip(fields, texts):
        out.append(F.struct(F.lit(f).alias("name"), at.alias("start"), (at + F.length(t)).alias("end")))
        at = at + F.length(t)
    return docs.withColumn(text_col, F.concat(*texts)).withColumn(sections_col, F.array(*out))
