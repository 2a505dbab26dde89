"""A corpus from raw documents to token ids, one operator a stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet to the shared folder and
read again as the next stage's ``docs``. All stages but the last return the columns of ``documents``: null texts count
as empty, rows repeated exactly stay together, further columns stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import bpe, columns, decontaminate, line_dedup, near_dup, quality_ranking
from tributary.session import written_once

VOCABULARY = "word_bpe_49k.json"
NEAR = 80  # per cent of the shingles of two documents that make them near duplicates


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking accepts; it learns from the labelled documents among ``docs``."""
    labels = quality_ranking.learning_rows(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_ranking.accepted_by_labels(docs, labels)


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sites. A document all of whose words went with them is dropped."""
    cleaned = line_dedup.without_boilerplate(docs)
    emptied = (F.col("lines_removed") > 0) & (F.size(columns.words(F.col("text"))) == 0)
    return cleaned.where(~emptied).select(
        *[F.char_length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    )


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return near_dup.without_copies(docs, least=NEAR)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, as little-endian 32-bit integers, and digests of them and of what they decode to."""
    vocabulary = bpe.with_lexicon(docs, public_tokenizers.path(VOCABULARY))
    both = bpe.round_trip(docs, vocabulary)
    return both.select(
        "doc_id",
        "ids",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", accept_quality),
    ("lines", remove_boilerplate),
    ("near_duplicates", keep_one_of_each),
    ("benchmark", drop_leaks),
    ("encoding", encode),
]

# Learned scores, latent vectors and token ids are beyond SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written_once(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
