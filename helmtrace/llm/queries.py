"""The registered queries of this package; each derives its contract columns from an operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmtrace.llm import decontamination, embedding_dedup, pii, quality_model, simhash, vantage_clusters, whitening
from helmtrace.llm.byte_bpe import decode, encode
from helmtrace.llm.common import table, whole
from helmtrace.llm.html_text import extract
from helmtrace.llm.line_dedup import dedup_lines
from helmtrace.llm.packing import pack
from helmtrace.llm.quality_rules import judge
from helmtrace.llm.token_counts import attribute_sections

Query = Callable[[SparkSession, str], DataFrame]

#: Vocabulary files, by their place on every machine.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
COUNT_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_PIECES = public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the divergence verdict of every document."""
    out = judge(table(spark, sf_dir, "documents"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select("doc_id", *[F.col(f"_{n}").alias(n) for n in names])


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS).select("doc_id", "_ids")
    return decode(coded, RANKS).select(
        "doc_id",
        (F.octet_length("_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("_ids", 256).alias("ids_sha256"),
        F.sha2("_decoded", 256).alias("decoded_sha256"),
    )


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shared across documents, kept in the first document only."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256")
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, from one encoding of the whole document."""
    out = attribute_sections(table(spark, sf_dir, "documents").select("doc_id", "text"), COUNT_RANKS)
    each = out.select("doc_id", F.col("_tokens.n_tokens").alias("doc_tokens"), F.posexplode(F.arrays_zip("_sections", F.col("_tokens.counts").alias("counts"))))
    return each.select(
        "doc_id",
        F.col("pos").cast("long").alias("section"),
        F.col("col._sections.name").alias("name"),
        F.col("col._sections.start").cast("long").alias("start"),
        F.col("col._sections.end").cast("long").alias("end"),
        F.col("col.counts").cast("long").alias("n_tokens"),
        "doc_tokens",
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: the patterns' spans and those that the tagger adds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.find(docs, pii.fit(docs))
    counts = [pii.count_spans("_base", k).alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(pii.spans_text("_base"), 256).alias("base_sha256"), pii.spans_text("_spans").alias("spans"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_model.classify(docs, table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id",
        (quality_model.fold("doc_id") == quality_model.HELD_OUT).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, placed into sequences."""
    return pack(table(spark, sf_dir, "documents"), WORD_PIECES, with_ids=False)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of every sound vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the benchmark every document holds."""
    out = decontamination.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.col("_n_hit") > 0).alias("contaminated"),
    )


def op13_vantage_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every kept vector."""
    return vantage_clusters.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_html_text": op3_html_text,
    "op4_simhash": op4_simhash,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_pii": op7_pii,
    "op8_quality_model": op8_quality_model,
    "op9_packing": op9_packing,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_whitening": op11_whitening,
    "op12_decontamination": op12_decontamination,
    "op13_vantage_clusters": op13_vantage_clusters,
}
