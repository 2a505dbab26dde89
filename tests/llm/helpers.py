"""Fixtures and plain-Python references for the training-text operators."""

import random
import re

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = ["id", "row", "w", "t", "c", "n", "word", "words", "tokens", "score", "kept", "at", "line", "hash", "site", "gone", "by", "x", "template"]


def corpus(spark, name="documents"):
    return spark.read.parquet(f"{SF_DIR}/{name}.parquet")


def texts(spark):
    return {r["doc_id"]: r["text"] for r in corpus(spark).select("doc_id", "text").collect()}


def prose(seed, n):
    """``n`` invented words."""
    rng = random.Random(seed)
    parts = ["ha", "ter", "on", "ing", "the", "lo", "mi", "ra", "est", "un"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_rows():
    """Null fields, empty and long texts, repeated rows and ids, odd characters."""
    long = prose(1, 30_000)
    shared = prose(2, 80)
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", "b", 0),
        (3, " \t\n\x0b\x0c\r ", None, None, 7),
        (4, long, "en", "a", len(long)),
        (5, shared, "en", "c", None),
        (5, shared, "en", "c", None),
        (6, shared, "en", None, None),
        (7, prose(3, 60), "en", "a", None),
        (7, prose(4, 60), "en", "a", None),
        (None, shared, "en", "a", None),
        (None, None, None, None, None),
        (8, "x" * 100_000, "en", "a", None),
        (9, "7" * 30_000, "en", "a", None),
        (10, "a@" * 5_000, "en", "a", None),
        (11, "éÈ ß日本 \U0001f600 \x00 \\ <s> </s> [INST] $1 %s", "fr", "a", None),
        (12, "\n" * 2_000, "en", "a", None),
        (-5, "one two three", "en", "b", None),
    ]
    return rows


def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


def wide(docs):
    """``docs`` with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(i).alias(name) for i, name in enumerate(CLASHING)])


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)
