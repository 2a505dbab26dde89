"""Nearest neighbours by cosine distance, exact or over the probed cells of a partitioned index.

Vectors are scored where they are read: each task multiplies its Arrow batches with a block of queries and keeps ``k``
rows per query, so the corpus is never shuffled and no pair outside a task's best is emitted. The queries are written
to the shared folder first and counted there; a block holds at most ``BLOCK_VALUES`` numbers, and a larger query set
takes one scan of the corpus per block. What the tasks found is thinned per query in spread groups, then ranked.

Distances are rounded to 6 places and ties go to the smaller id, so results do not depend on how the
corpus is partitioned. A zero vector is at distance 1.0 from everything; NULL, NaN and infinite values fail the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.session import written_once

PLACES = 6
BLOCK_VALUES = 4_000_000  # numbers in a block of queries (32 MB of doubles)
CELL_VALUES = 2_000_000  # distances held at once while scoring one batch
FOUND_ROWS = 500_000  # candidates a task gathers before it cuts them to the best of each query
SPREAD = 64  # groups in which a query's candidates are thinned


class VectorLengthError(ValueError):
    """Vectors of one search differ in length."""


class VectorValueError(ValueError):
    """A vector has a value that no distance can be taken of."""


def _matrix(vectors: pa.Array | pa.ChunkedArray, dim: int | None) -> np.ndarray:
    """Unit rows of a list array; zero vectors stay zero."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if vectors.null_count:
        raise VectorLengthError("a vector is NULL")
    lengths = np.unique(np.diff(vectors.offsets.to_numpy()))
    if len(lengths) > 1 or (len(lengths) and dim is not None and lengths[0] != dim):
        raise VectorLengthError(f"vector lengths {lengths.tolist()}, expected {dim}")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("float64")
    if not np.isfinite(flat).all():
        raise VectorValueError("a vector has a value that is NULL, NaN or infinite")
    rows = flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, dim or 0))
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _best(found: pa.Table, k: int) -> pa.Table:
    """The first ``k`` rows per query by distance and id."""
    found = found.sort_by([("q", "ascending"), ("dist", "ascending"), ("id", "ascending")])
    q = found.column("q").to_numpy()
    begins = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q))))
    return found.filter(pa.array(place < k))


class _Found:
    """The ``k`` nearest rows of each query among those added; what is held does not grow with the rows."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.reach = np.full(len(queries), np.inf)  # distance of each query's k-th row so far
        self.tables: list[pa.Table] = []
        self.kept = self.new = 0

    def add(self, ids: pa.Array, unit: np.ndarray, asking: np.ndarray) -> None:
        """Compare rows with the queries at the places ``asking``."""
        queries = (self.queries if len(asking) == len(self.queries) else self.queries[asking]).T
        step = max(1, CELL_VALUES // max(1, len(asking)))
        for start in range(0, len(unit), step):
            part = unit[start : start + step]
            distance = np.round(1.0 - part @ queries, PLACES) + 0.0
            most = self.reach[asking]
            if len(part) > self.k:
                most = np.minimum(most, np.partition(distance, self.k - 1, axis=0)[self.k - 1])
            row, query = np.nonzero(distance <= most)
            if len(row):
                near = {"q": asking[query], "id": ids.take(pa.array(start + row)), "dist": distance[row, query]}
                self.tables.append(pa.table(near))
                self.new += len(row)
            if self.new >= max(FOUND_ROWS, self.kept):
                self.best()

    def best(self) -> pa.Table | None:
        if self.new:
            found = _best(pa.concat_tables(self.tables), self.k)
            q = found.column("q").to_numpy()
            last = np.flatnonzero(q[self.k - 1 :] == q[: max(0, len(q) - self.k + 1)]) + self.k - 1
            self.reach[q[last]] = found.column("dist").to_numpy()[last]
            self.tables, self.kept, self.new = [found], len(q), 0
        return self.tables[0] if self.tables else None


def _scorer(names: pa.Array, queries: np.ndarray, probes: np.ndarray | None, k: int):
    """A ``mapInArrow`` function over ``(id, vec[, cell])`` that yields each task's best ``(query_id, id, dist)``."""
    every = np.arange(len(queries))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found(queries, k)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, unit = batch.column("id"), _matrix(batch.column("vec"), queries.shape[1])
            if probes is None:
                found.add(ids, unit, every)
            else:
                cells = batch.column("cell").to_numpy(zero_copy_only=False)
                for cell in np.unique(cells):
                    asking, rows = every[probes[:, cell]], np.flatnonzero(cells == cell)
                    if len(asking):
                        found.add(ids.take(pa.array(rows)), unit[rows], asking)
        best = found.best()
        if best is not None:
            best = best.combine_chunks()
            columns = [names.take(best.column("q").combine_chunks()), best.column("id").combine_chunks(), best.column("dist").combine_chunks()]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "id", "dist"])

    return score


def nearest(
    corpus: DataFrame, queries: DataFrame, k: int, cells: int | None = None, block_values: int = BLOCK_VALUES
) -> DataFrame:
    """The ``k`` nearest rows of ``corpus(id, emb[, cell])`` for each row of ``queries(query_id, emb[, probe])``.

    Returns ``(query_id, id, dist, rank)``. With ``cells`` given, a query is compared only with rows
    whose ``cell`` is in its array ``probe``; cell numbers run from 0 to ``cells - 1``.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    asked = written_once(queries.select("query_id", "emb", *(["probe"] if cells is not None else [])))
    numbers = asked.agg(F.coalesce(F.sum(F.size("emb")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-numbers // block_values))
    local = None
    for block in range(blocks):
        taken = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        found = _score(corpus, taken, queries.schema["query_id"].dataType, k, cells)
        local = found if local is None else local.unionByName(found)
    return ranked(local, k)


def _score(corpus: DataFrame, taken: pa.Table, id_type: T.DataType, k: int, cells: int | None) -> DataFrame:
    shape = T.StructType(
        [
            T.StructField("query_id", id_type),
            T.StructField("id", corpus.schema["id"].dataType),
            T.StructField("dist", T.DoubleType()),
        ]
    )
    if not taken.num_rows:
        return corpus.sparkSession.createDataFrame([], shape)
    probes = None
    rows = corpus.select("id", F.col("emb").alias("vec"))
    if cells is not None:
        probes = np.zeros((taken.num_rows, cells), dtype=bool)
        for q, mine in enumerate(taken.column("probe").to_pylist()):
            probes[q, mine] = True
        # The condition on the partition column keeps files of other cells from being opened.
        wanted = [int(c) for c in np.nonzero(probes.any(axis=0))[0]]
        rows = corpus.filter(F.col("cell").isin(wanted)).select("id", F.col("emb").alias("vec"), "cell")
    names = taken.column("query_id").combine_chunks()
    return rows.mapInArrow(_scorer(names, _matrix(taken.column("emb"), None), probes, k), shape)


def ranked(local: DataFrame, k: int) -> DataFrame:
    """Global top-k of task-local top-k rows: first in spread groups, as every task may have found k for each query."""
    order = [F.asc("dist"), F.asc("id")]
    some = Window.partitionBy("query_id", "_part").orderBy(*order)
    thinned = (
        local.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(SPREAD)))
        .withColumn("_rank", F.row_number().over(some))
        .filter(F.col("_rank") <= k)
        .drop("_part", "_rank")
    )
    per_query = Window.partitionBy("query_id").orderBy(*order)
    return thinned.withColumn("rank", F.row_number().over(per_query)).filter(F.col("rank") <= k)


# ---- around a search -------------------------------------------------------------------------------


def search_documents(vectors: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, rank, id, text, meta, score)``: nearest documents, where vectors and documents are apart.

    A vector without a document never surfaces: vectors are cut to existing documents first, and
    texts are fetched for the few hits only.
    """
    present = vectors.join(docs.select("id"), "id", "left_semi")
    found = docs.select("id", "text", "meta").join(nearest(present, queries, k), "id")
    return found.select("query_id", "rank", "id", "text", "meta", F.col("dist").alias("score"))


def integrity(vectors: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: documents without a vector, vectors without a document, and whether both are none."""
    bare = docs.select("id").join(vectors.select("id"), "id", "left_anti").agg(
        F.count(F.lit(1)).alias("docs_without_vector")
    )
    orphans = vectors.select("id").join(docs.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    clean = (F.col("docs_without_vector") == 0) & (F.col("vectors_without_doc") == 0)
    return bare.withColumn("vectors_without_doc", orphans.scalar()).withColumn("one_to_one", clean)


def self_nearest(vectors: DataFrame, samples: DataFrame) -> DataFrame:
    """How many of ``samples(query_id, emb)`` have their nearest neighbour at their own place (distance 0)."""
    first = nearest(vectors, samples, 1)
    at_self = F.sum(F.when(F.abs("dist") < 1e-5, 1).otherwise(0))
    return first.agg(F.count(F.lit(1)).alias("sampled"), at_self.cast("bigint").alias("at_self"))
