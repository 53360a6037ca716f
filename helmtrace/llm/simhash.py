"""SimHash near-dedup by pigeonhole blocks.

A text's fingerprint has 64 bits, one vote per 3-word shingle. Fingerprints that differ in at most
``MAX_BITS`` bits are linked. Equal fingerprints are one node from the start, so copies never meet.

Blocks: the 64 bits are split into ``BLOCKS`` parts. Two fingerprints within two bits agree on at
least ``BLOCKS - 2`` parts, so they share one of the C(5, 3) keys of about 38 bits; joining on a key
and verifying the Hamming distance finds every link. A key held by more than ``CROWDED`` fingerprints
(a crowd of near copies) is not joined. Its members are expanded to their 65 neighbours within one
bit instead: fingerprints within two bits share such a neighbour, and fingerprints that share one are
within two bits, so grouping by neighbour gives the same components exactly, without any pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helmtrace.llm.common import stored, whole
from helmtrace.llm.components import components

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
BLOCKS = 5
# Beyond this many members the 65 neighbours of each cost less than its pairs in all ten tables.
CROWDED = 12
_VOTES_AT_ONCE = 65_536


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text, unsigned; 0 for null and for texts without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - shingle_words + 1].tolist(), ends[shingle_words - 1 :].tolist())
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _VOTES_AT_ONCE):
        part = hashes[at : at + _VOTES_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def add_fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "_fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long (the same 64 bits)."""

    @F.pandas_udf(T.LongType())
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(out_col, prints(F.col(f"`{text_col}`")))


def block_masks(blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> list[int]:
    """The bits of every choice of parts that a close pair may agree on, as signed longs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _distance(a: str, b: str) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def link_fingerprints(prints: DataFrame, fp_col: str = "fp") -> DataFrame:
    """Edges ``a, b`` whose components are those of all pairs of fingerprints within ``MAX_BITS`` bits.

    ``prints`` holds distinct fingerprints. Edges from blocks join two fingerprints; edges from crowds
    join a fingerprint with the smallest one that shares a one-bit neighbour with it.
    """
    masks = F.array(*[F.lit(m) for m in block_masks()])
    keyed = prints.select(F.col(fp_col).alias("fp"), F.posexplode(masks).alias("t", "mask"))
    keyed = keyed.select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("least"))
    shared = stored(sizes.where("n > 1"), "shared-blocks")
    members = stored(keyed.join(shared, ["t", "key"]), "block-members")
    calm = members.where(F.col("n") <= CROWDED).select("t", "key", "fp")
    pairs = (
        calm.select("t", "key", F.col("fp").alias("a"))
        .join(calm.select("t", "key", F.col("fp").alias("b")), ["t", "key"])
        .where((F.col("a") < F.col("b")) & (_distance("a", "b") <= MAX_BITS))
        .select("a", "b")
    )
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    crowd = stored(members.where(F.col("n") > CROWDED).select("fp").distinct(), "crowd")
    near = crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    least = near.groupBy("near").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).where("a < most")
    stars = near.join(least.select("near", "a"), "near").where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, fp, component_id``.

    ``component_id`` is the smallest id that can be reached over links. Texts without words have the
    fingerprint zero and are linked like any other; repeated rows of an id are returned each. A null id
    never names a component: a group that holds nothing else has a null ``component_id``.
    """
    prints = stored(add_fingerprints(docs.select(F.col(id_col).alias("id"), whole(text_col).alias("txt")), "txt", "fp").select("id", "fp"), "fingerprints")
    least = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct-prints")
    found = components(link_fingerprints(least.select("fp")))
    # Most fingerprints have no link: only those of the linked components need a second minimum.
    linked = least.join(found, least["fp"] == found["node"]).select("fp", "component", "least")
    ids = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = linked.join(ids, "component").select(F.col("fp").alias("moved"), "component_id")
    named = least.join(moved, least["fp"] == moved["moved"], "left").select(
        "fp", F.coalesce("component_id", "least").alias("component_id")
    )
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one per component, the one with the smallest id.

    Rows with a null id stay. Of repeated rows with the id that stays, all stay. If an id stands on rows with
    different texts, each row stays or goes by its own fingerprint.
    """
    found = near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone"), F.col("fp").alias("_gone_fp")).distinct()
    own = add_fingerprints(docs, text_col, "_own_fp")
    return own.join(gone, (own[id_col] == gone["_gone"]) & (own["_own_fp"] == gone["_gone_fp"]), "left_anti").drop("_own_fp")
