"""Text to vector: the hashing embedder, pluggable models, and embedding each text once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions import text as text_functions
from tributary.functions import vectors

# A model: a batch of texts to a (len(texts), dim) array of floats.
Model = Callable[[Sequence[str]], np.ndarray]

REMEMBERED = 1_000_000  # tokens whose bucket a batch keeps at hand

_LETTERS = re.compile("[a-z]+")
_FOLD = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}


def hash_buckets(docs: DataFrame, dim: int, key: str = "id", text: str = "text") -> DataFrame:
    """``(key, bucket, n)``: how many tokens of each text fall into each bucket.

    Built-in functions only. A task sees a text's tokens together, so they shrink to at most ``dim``
    rows per text before the shuffle.
    """
    words = docs.select(key, F.explode(text_functions.tokens(F.col(text))).alias("token"))
    return (
        words.select(key, text_functions.token_bucket(F.col("token"), dim).alias("bucket"))
        .groupBy(key, "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


class _Buckets(dict):
    """Token to bucket, remembered while there is room."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        bucket = self[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dim
        return bucket


def hash_model(dim: int) -> Model:
    """The offline model: bucket counts scaled to length 1; a text without tokens is all zeros."""

    def embed(texts: Sequence[str]) -> np.ndarray:
        buckets = _Buckets(dim)
        out = np.zeros((len(texts), dim), dtype="float64")
        for row, text in enumerate(texts):
            found = [buckets[token] for token in _LETTERS.findall((text or "").translate(_FOLD))]
            if found:
                out[row] = np.bincount(found, minlength=dim)
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norms, out=out, where=norms > 0).astype("float32")

    return embed


def embed_column(text: Column, model: Model) -> Column:
    """``model`` over a text column, one call per Arrow batch, no shuffle."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            vectors = np.asarray(model(batch.fillna("").tolist()), dtype="float32")
            yield pd.Series(list(vectors), index=batch.index)

    return embed(text)


def embed_given(text: Column, model: Model) -> Column:
    """``model`` over the texts that are not NULL; the others have no vector and do not reach the model."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            given = batch.notna().to_numpy()
            if given.any():
                vectors = np.asarray(model(batch[given].tolist()), dtype="float32")
                found[given] = pd.Series(list(vectors), index=batch.index[given])
            yield found

    return embed(text)


def hash_vector(text: Column, dim: int) -> Column:
    """The vectors of :func:`hash_model` by built-in functions, so that joins move below them."""
    buckets = F.transform(text_functions.tokens(text), lambda t: text_functions.token_bucket(t, dim))

    def scaled(counts: Column) -> Column:
        norm = F.sqrt(F.aggregate(counts, F.lit(0).cast("bigint"), lambda total, n: total + n * n).cast("double"))
        return F.transform(counts, lambda n: F.when(norm > 0, n / norm).otherwise(F.lit(0.0)).cast("float"))

    return vectors.let(vectors.bucket_counts(buckets, dim), scaled)


def embed_documents(
    docs: DataFrame, model: Model, model_name: str, key: str = "id", text: str = "text"
) -> DataFrame:
    """``(key, emb, model, text_hash)``: the vector, the model that made it and the text it was made of."""
    return docs.select(
        key,
        embed_column(F.col(text), model).alias("emb"),
        F.lit(model_name).alias("model"),
        text_hash(F.col(text)).alias("text_hash"),
    )


def text_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def needs_embedding(
    docs: DataFrame, vectors: DataFrame, model_name: str, key: str = "id", text: str = "text"
) -> DataFrame:
    """The documents whose current text has no stored vector of this model."""
    stored = vectors.filter(F.col("model") == model_name).select(key, "text_hash")
    hashed = docs.withColumn("text_hash", text_hash(F.col(text)))
    return hashed.join(stored, [key, "text_hash"], "left_anti").select(docs.columns)


def of_model(vectors: DataFrame, model_name: str) -> DataFrame:
    """``vectors``, failing the job on a vector of another model: distances across models mean nothing."""
    other = F.raise_error(
        F.concat(F.lit(f"query model {model_name}, stored model "), F.coalesce("model", F.lit("unknown")))
    )
    same = F.col("model").eqNullSafe(F.lit(model_name))
    return vectors.withColumn("model", F.when(same, F.col("model")).otherwise(other.cast("string")))


def generate_column(prompt: Column, model: Callable[[Sequence[str]], Sequence[str]] | None) -> Column:
    """Answers of a text model, one call per Arrow batch; no model means an empty answer."""
    if model is None:
        return F.lit("")

    @F.pandas_udf("string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([str(a).strip() for a in model(batch.tolist())], index=batch.index)

    return answer(prompt)


def offline_answers(prompts: Sequence[str]) -> list[str]:
    """The stand-in for a text model when none is reachable."""
    return ["[offline] generation is disabled"] * len(prompts)
