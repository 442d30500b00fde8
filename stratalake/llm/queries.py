"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.llm import bit_planes, byte_bpe, decontaminate, exact_dedup, jaccard, licenses, lm_score, periodic, quality, repeats, toxicity, warc, yinyang
from stratalake.llm.common import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bit_planes.encode_to_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2).drop("path")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lm_score.score(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = quality.score(docs, quality.fit(docs, labels), "doc_id")
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.report(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64, prefix="1:")


def planted_period(doc_id: int | None, n: int) -> np.ndarray | None:
    """Where each of ``n`` words is taken from: in a tenth of the documents, chosen by crc32 of doc_id, a part repeats to the end."""
    if doc_id is None or not n:
        return None
    g, tenth = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if tenth:
        return None
    a = g % n
    source = np.arange(n)
    source[a:] = a + (source[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return source


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(_table(spark, sf_dir, "documents"), edit=planted_period))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), "doc_id")
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "toxic_logprob", "ordinary_logprob",
    )


QUERIES = {f.__name__: f for f in (
    op1_bit_planes, op2_decontaminate, op3_warc_bundles, op4_exact_dedup, op5_lm_score, op6_jaccard, op7_quality, op8_repeats, op9_licenses, op10_byte_bpe,
    op11_yinyang, op12_periodic_runs, op13_toxicity,
)}
