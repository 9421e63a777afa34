"""Documents to token ids: quality rules, line dedup, near-dedup, mixing, byte-level BPE."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encodelens.llm import bpe, linededup, mixing, neartexts, quality
from encodelens.llm.common import columns, drop_written, small_batches, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cascade; the others go.

    A null text fails the base rules; columns may have any names; repeated rows are judged alike; no rows give none.
    """
    small_batches(spark)
    return quality.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; n_chars follows the text, and no document goes.

    Copies of a text count as one page, so that a group of copies keeps its text for the next stage.
    """
    small_batches(spark)
    out = linededup.drop_boilerplate(docs)
    n = F.when(F.col("_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n).select(*columns(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id: five-word shingles, similarity 0.8 or more."""
    small_batches(spark)
    return neartexts.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document that it does not take goes."""
    small_batches(spark)
    return mixing.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and what they decode to: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    A null text counts as empty and has no token; repeated rows and null ids keep their rows; no rows give none.
    """
    small_batches(spark)
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.with_decoded(bpe.tokenize(docs, ranks, pattern), ranks, pattern)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]

#: SQL cannot express the last stage; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        drop_written(before)
    return STAGES[-1][1](spark, docs, sf_dir)
