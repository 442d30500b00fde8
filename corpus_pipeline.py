"""Corpus pipeline: from raw documents to token ids.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the rows it keeps, with all columns of ``docs``; the last returns ids.
``run`` writes each stage's rows as Parquet in the shared folder and reads them
back for the next, so every stage works on all that its predecessor kept and a
lost executor never undoes a finished stage.

What all stages do with odd rows: null and empty texts count as texts without
words; texts of any length are read whole; columns other than doc_id and text,
whatever their names, stay as they are and are never read; an empty table gives
an empty result with the same columns.  Each stage says below what becomes of
nulls, ties and repeated rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stratalake.llm import byte_bpe, decontaminate, exact_dedup, jaccard, quality
from stratalake.llm.common import prepare, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier rejects (score below 0.3).

    Rows are judged one by one, so equal texts share their fate and repeated rows
    stay as often as they occur; a null or empty text has the score of the bias
    alone.  Rows without doc_id are judged like all others, but never learned from.
    Without labels every score is 0.5 and all rows stay.
    """
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.filter_quality(docs, quality.fit(docs, labels), 0.3)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the smallest doc_id.

    Texts are equal up to runs of white space; null counts as empty.  A null
    doc_id comes last; of rows that tie in text and doc_id exactly one stays.
    """
    prepare(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents keep the smallest doc_id.

    Rows without words or without doc_id link with nothing and stay.  Rows that
    share a doc_id are one document: all stay or none.  Similarity is a Jaccard
    share of 0.75 or more of five-word shingles, ties of exactly 0.75 included.
    """
    prepare(spark)
    return jaccard.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold half or more of a benchmark item.

    Rows are judged one by one, so repeated rows share their fate; null and empty
    texts and rows without doc_id are judged like all others.  An item of exactly
    half coverage counts.  Without benchmark items all rows stay.
    """
    prepare(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of ids and of the decoded bytes.

    One row a row: repeated rows and null doc_ids stay; null and empty texts have
    no ids.
    """
    prepare(spark)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

#: A classifier, a tiling and a tokenizer are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
