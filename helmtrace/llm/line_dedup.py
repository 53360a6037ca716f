"""Line dedup: a line that several documents share stays only in the first of them.

Only 128-bit hashes of line keys travel, never text. They are range-partitioned by
``(hash, document, position)`` and sorted, so a line that a third of all documents hold is spread over
many partitions. The first and last document per hash are found by aggregation over the stored hashes,
with one row per hash and task merged, and the marks by a join back; the sorted order is not used for it, since a
run may cross partitions and the aggregation needs no Python and no table of edges. What comes back per document is a sparse bitmap of dropped lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helmtrace.llm.common import WHITE, stored, whole, without

MIN_KEY_CHARS = 10
WORD_BITS = 64
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """Document, version of its text, position and key hashes of every line whose key is long enough."""
    lines = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc"),
        F.xxhash64(whole(text_col)).alias("version"),
        F.posexplode(F.split(whole(text_col), "\n")).alias("pos", "line"),
    )
    keys = lines.select("doc", "version", "pos", F.translate(F.btrim("line", F.lit(WHITE)), _UPPER, _UPPER.lower()).alias("key"))
    return keys.where(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc", "pos", "version"
    )


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """One row per document that loses lines: ``doc, version, n_dropped, dropped``.

    ``dropped`` maps the number of a 64-line word to its bits (bit ``i`` set: line ``64 * word + i`` goes);
    words that lose nothing are left out, which is the compression. A line goes if its key (stripped,
    A-Z lower-cased, at least ``min_chars`` code points) is also held by a document with a smaller id.

    Null texts count as one empty line. Rows with a null id hold nothing and lose nothing. Repeated rows
    of one id are one document; ``version`` (hash of the text) tells different texts of one id apart.
    """
    order = ["h1", "h2", "doc", "pos"]
    lines = line_hashes(docs, id_col, text_col, min_chars)
    lines = stored(lines.repartitionByRange(*order).sortWithinPartitions(*order), "line-hashes")
    first = lines.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    shared = first.where("first < last").drop("last")
    gone = lines.join(shared, ["h1", "h2"]).where("doc > first")
    words = (
        gone.select("doc", "version", "pos")
        .repartition("doc", "version")
        .groupBy("doc", "version", F.expr(f"pos div {WORD_BITS}").alias("word"))
        .agg(F.expr(f"bit_or(shiftleft(1L, pos % {WORD_BITS}))").alias("bits"))
    )
    return words.groupBy("doc", "version").agg(
        F.sum(F.bit_count("bits")).alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``text_col`` cut to its kept lines, ``_n_lines`` and ``_n_dropped``.

    Columns of ``docs`` with these names, or ``_version``, ``_doc``, ``_bits_version``, ``_dropped``, are replaced.
    """
    docs = without(docs, "_n_lines", "_n_dropped", "_version", "_doc", "_bits_version", "_dropped")
    keyed = docs.select("*", F.xxhash64(whole(text_col)).alias("_version"))
    right = bitmaps.select(F.col("doc").alias("_doc"), F.col("version").alias("_bits_version"), "n_dropped", "dropped")
    right = right.withColumnsRenamed({"n_dropped": "_n_dropped", "dropped": "_dropped"})
    both = keyed.join(right, (F.col(id_col) == F.col("_doc")) & (F.col("_version") == F.col("_bits_version")), "left")
    text = F.when(F.col("_dropped").isNull(), whole(text_col)).otherwise(
        F.expr(
            f"array_join(filter(split(coalesce(`{text_col}`, ''), '\\n'), (line, i) -> "
            f"NOT coalesce(getbit(_dropped[CAST(i AS BIGINT) div {WORD_BITS}], i % {WORD_BITS}) = 1, false)), '\\n')"
        )
    )
    return both.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.size(F.split(whole(text_col), "\n")).cast("long").alias("_n_lines"),
        F.coalesce("_n_dropped", F.lit(0)).cast("long").alias("_n_dropped"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """``docs`` without the lines that a document with a smaller id already has; see ``keep_bitmaps``."""
    return apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, min_chars), id_col, text_col)
