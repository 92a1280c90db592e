"""A document pipeline: quality, near copies, repeated passages, benchmark leaks, tokens.

Each stage works on what its predecessor kept; all but the last return the
columns of ``documents``. ``run`` writes every stage as Parquet in the shared
folder and reads it back for the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartrail.functions.durable import shared_folder
from cartrail.llm import chunk_bpe, line_dedup, quality_qda, simhash_decon, simhash_dedup
from cartrail.llm.common import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the discriminant rejects. It learns from the labelled documents of the stage's input.

    Null and empty texts are scored like others; without labels every document stays or goes by the score 0.5.
    """
    return quality_qda.accepted(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near copies: 3-word shingles, at most 3 of 64 bits apart.

    Null and empty texts are near copies of each other; equal rows leave one, and
    a null id gives way to any other.
    """
    return simhash_dedup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated lines and sentences out of the texts; ``n_chars`` follows the text."""
    cut = line_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("bigint"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage. Null and empty texts hold none and stay."""
    return simhash_decon.clean_of(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left: the columns of documents with ``n_tokens`` and digests of ids and decoded text.

    A null text is encoded as an empty one; repeated rows stay.
    """
    return chunk_bpe.encoding_report(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_copies),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("bpe encoding", tokens),
]

# Fingerprints and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents``."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
