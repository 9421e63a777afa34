"""Each operator over its whole table with production parameters, and SQL for the same rows where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encodelens.llm import bpe, divergence, hilbert, htmltext, langid, linededup, mixing, negatives, quality, simhash, tokenfiles, topk, vectors
from encodelens.llm.common import scratch, small_batches, table
from encodelens.llm.oracles import DIVERGENCE, LINE_DEDUP, MIXING, NEGATIVES, QUALITY, SHARDS, TOP_K


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).drop("failed")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = bpe.tokenize(table(spark, sf_dir, "documents"), ranks, pattern)
    out = bpe.with_decoded(tokens, ranks, pattern)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.predict(docs.select("doc_id", langid.held_out().alias("held_out"), "text"), model)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = f"{scratch(spark)}/token-files-{uuid.uuid4().hex}"
    tokenfiles.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    out = tokenfiles.read_tokens(spark, path)
    return out.select(F.col("id").alias("doc_id"), "start", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = htmltext.main_text(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = linededup.drop_boilerplate(docs)
    return out.select("doc_id", F.col("_lines").cast("long").alias("n_lines"), F.col("_dropped").cast("long").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op8_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    sized = mixing.word_counts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    out = mixing.mix(sized)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(moved, F.col("id") % 100 == 0)


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_hilbert_shards": op3_hilbert_shards,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_entropy_mix": op8_entropy_mix,
    "op9_token_files": op9_token_files,
    "op10_html_main_text": op10_html_main_text,
    "op11_source_divergence": op11_source_divergence,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_exact_top_k": op13_exact_top_k,
}

ORACLES: dict[str, str] = {"op1_quality_rules": QUALITY, "op3_hilbert_shards": SHARDS, "op6_line_dedup": LINE_DEDUP, "op8_entropy_mix": MIXING, "op11_source_divergence": DIVERGENCE, "op12_hard_negatives": NEGATIVES, "op13_exact_top_k": TOP_K}
