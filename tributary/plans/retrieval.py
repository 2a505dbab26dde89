"""Embedding, nearest neighbours, the partitioned index and cited prompts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import vectors
from tributary.operators import embedding, ivf, knn, prompts, stats
from tributary.plans import inputs
from tributary.plans.inputs import CENTROID_SQL, DIM, embed_sql, table, top_sql
from tributary.session import shared_dir

CELLS = 16


def hash_embed_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.hash_buckets(table(spark, sf_dir, "documents"), DIM, "doc_id", "text")


def hash_embed_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense vectors as text, six decimals."""
    emb = vectors.vector_to_json(F.col("emb"), 6).alias("emb")
    return inputs.doc_vectors(spark, sf_dir).select("id", emb)


def vector_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors to text and back; the length of what comes back, and its sum to three places."""
    text = inputs.stored_vectors(spark, sf_dir).select("id", vectors.vector_to_json(F.col("emb"), 5).alias("emb"))
    back = vectors.vector_from_json(F.col("emb"))
    total = F.aggregate(back, F.lit(0.0).cast("double"), lambda a, x: a + F.round(x.cast("double"), 5))
    return text.select("id", "emb", F.size(back).alias("dim"), F.round(total, 3).alias("total"))


def cosine_to_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of every stored vector to the mean of its label."""
    stored = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    means = inputs.label_centroids(spark, sf_dir).withColumnRenamed("query_id", "label")
    distance = vectors.cosine_distance(F.col("embedding"), F.col("emb"))
    return stored.join(means, "label").select("vec_id", F.round(distance, 6).alias("dist"))


def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest documents of every benchmark text."""
    return knn.nearest(inputs.doc_vectors(spark, sf_dir), inputs.query_vectors(spark, sf_dir), 10)


def knn_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten stored vectors nearest to the mean of each label."""
    return knn.nearest(inputs.stored_vectors(spark, sf_dir), inputs.label_centroids(spark, sf_dir), 10)


def knn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search with the queries in several blocks."""
    return knn.nearest(inputs.stored_vectors(spark, sf_dir), inputs.label_centroids(spark, sf_dir), 10, block_values=4 * DIM)


def _index(spark: SparkSession, index: ivf.IvfIndex) -> ivf.IvfIndex:
    return ivf.stored(index, f"{shared_dir(spark)}/index/{uuid.uuid4().hex}")


def knn_ivf_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index with every cell probed, which must equal the exact search."""
    index = _index(spark, ivf.build(inputs.stored_vectors(spark, sf_dir), CELLS))
    return index.search(inputs.label_centroids(spark, sf_dir), 10, probes=CELLS)


def _query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100, as queries against all."""
    asked = inputs.stored_vectors(spark, sf_dir).where(F.col("id") % 100 == 0)
    return asked.select(F.col("id").alias("query_id"), "emb")


def _certain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits from K-means cells, opened until no nearer row can be missed."""
    index = _index(spark, ivf.build(inputs.stored_vectors(spark, sf_dir), CELLS))
    return index.search_all(_query_set(spark, sf_dir), 10, first=2)


def knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _certain(spark, sf_dir)


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the index against the exact search."""
    exact = knn.nearest(inputs.stored_vectors(spark, sf_dir), _query_set(spark, sf_dir), 10)
    return stats.recall(_certain(spark, sf_dir), exact, 10)


def self_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.self_nearest(inputs.stored_vectors(spark, sf_dir), _query_set(spark, sf_dir))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a label; the vectors of all others are orphans."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return inputs.docs(spark, sf_dir).join(labels, "id", "left_semi")


def _labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their vectors; documents are cut to the labelled ones before they are embedded."""
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return inputs.text_vectors(table(spark, sf_dir, "documents").join(labels, "doc_id", "left_semi"), "doc_id", "id")


def search_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.search_documents(
        _labelled_vectors(spark, sf_dir), _labelled(spark, sf_dir), inputs.query_vectors(spark, sf_dir), 5
    )
    return found.select("query_id", "rank", "id", "text", F.get_json_object("meta", "$.source").alias("source"), "score")


def orphan_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return knn.integrity(inputs.stored_vectors(spark, sf_dir), labels)


def rag_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cited prompt per benchmark text from its three nearest labelled documents."""
    found = knn.search_documents(
        _labelled_vectors(spark, sf_dir), _labelled(spark, sf_dir), inputs.query_vectors(spark, sf_dir), 3
    )
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return prompts.cited_prompts(found, asked)


def needs_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to embed again when labelled ones are stored and the text of toxic ones has changed since."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic")
    docs = inputs.docs(spark, sf_dir)
    old = F.when(F.col("toxic") == 1, F.concat("text", F.lit(" (old)"))).otherwise(F.col("text"))
    stored = docs.join(labels, "id").select(
        "id", F.lit("hash-64").alias("model"), embedding.text_hash(old).alias("text_hash")
    )
    return embedding.needs_embedding(docs, stored, "hash-64").select("id")


QUERIES = {
    f.__name__: f
    for f in (
        hash_embed_buckets, hash_embed_vector, vector_text, cosine_to_centroid, knn_exact, knn_centroids, knn_blocks,
        knn_ivf_all_cells, knn_ivf, recall_at_k, self_nearest, search_with_text, orphan_vectors, rag_prompt,
        needs_embedding,
    )
}

_DOCS = embed_sql("dv", "documents", "doc_id")
_ASKED = embed_sql("qv0", "benchmark", "item_id")
_LABELLED = embed_sql("lv", "(SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))", "doc_id")
_QUERIES = f"{_ASKED}, qv AS (SELECT id AS query_id, emb FROM qv0)"
_STORED = "sv AS (SELECT vec_id AS id, embedding AS emb FROM embeddings)"
_ASKED_VECTORS = "s AS (SELECT vec_id AS query_id, embedding AS emb FROM embeddings WHERE vec_id % 100 = 0)"
_VECTOR_TEXT = "'[' || list_aggregate(list_transform({0}, lambda x: printf('%.{1}f', x::DOUBLE)), 'string_agg', ',') || ']'"

SQL = {
    "hash_embed_buckets": f"WITH {_DOCS} SELECT id AS doc_id, bucket, n FROM dv_b",
    "hash_embed_vector": f"WITH {_DOCS} SELECT id, {_VECTOR_TEXT.format('emb', 6)} AS emb FROM dv",
    "vector_text": f"""
        SELECT vec_id AS id, {_VECTOR_TEXT.format('embedding', 5)} AS emb, CAST(len(embedding) AS INTEGER) AS dim,
               round(list_sum(list_transform(embedding, lambda x: round(x::DOUBLE, 5))), 3) AS total
        FROM embeddings""",
    "cosine_to_centroid": f"""WITH {CENTROID_SQL}
        SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], emb::DOUBLE[]), 6) AS dist
        FROM embeddings JOIN cent ON cent.query_id = label""",
    "knn_exact": f"WITH {_DOCS}, {_QUERIES}, {top_sql('dv', 'qv', 10)} SELECT query_id, id, dist, rank FROM top",
    "knn_centroids": f"""WITH {CENTROID_SQL}, {_STORED}, {top_sql('sv', 'cent', 10)}
        SELECT query_id, id, dist, rank FROM top""",
    "self_nearest": f"""
        WITH {_STORED}, {_ASKED_VECTORS},
        {top_sql('sv', 's', 1)}
        SELECT count(*) AS sampled, count(*) FILTER (abs(dist) < 1e-5) AS at_self FROM top""",
    "search_with_text": f"""WITH {_LABELLED}, {_QUERIES}, {top_sql('lv', 'qv', 5)}
        SELECT query_id, rank, id, d.text AS text, d.source AS source, dist AS score
        FROM top JOIN documents d ON d.doc_id = id""",
    "orphan_vectors": """
        WITH a AS (SELECT count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)),
             b AS (SELECT count(*) AS n FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels))
        SELECT a.n AS docs_without_vector, b.n AS vectors_without_doc, a.n = 0 AND b.n = 0 AS one_to_one FROM a, b""",
    "rag_prompt": f"""WITH {_LABELLED}, {_QUERIES}, {top_sql('lv', 'qv', 3)},
        src AS (SELECT query_id, string_agg('[' || rank || '] ' || d.text || chr(10), '' ORDER BY rank) AS s
                FROM top JOIN documents d ON d.doc_id = id GROUP BY query_id)
        SELECT item_id AS query_id,
          'Answer the question using ONLY the numbered sources, citing inline like [1]. '
          || 'If they don''t answer it, say so.' || chr(10) || chr(10) || 'Sources:' || chr(10) || s
          || chr(10) || 'Question: ' || text || chr(10) || 'Answer:' AS prompt
        FROM benchmark JOIN src ON src.query_id = item_id""",
    "needs_embedding": """
        SELECT d.doc_id AS id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
        WHERE l.doc_id IS NULL OR l.toxic = 1""",
}
SQL["knn_ivf"] = f"WITH {_STORED}, {_ASKED_VECTORS}, {top_sql('sv', 's', 10)} SELECT query_id, id, dist, rank FROM top"
SQL["recall_at_k"] = f"""WITH {_STORED}, {_ASKED_VECTORS}, {top_sql('sv', 's', 10)}
        SELECT count(DISTINCT query_id) AS queries, 1.0::DOUBLE AS recall FROM top"""
SQL["knn_blocks"] = SQL["knn_centroids"]
SQL["knn_ivf_all_cells"] = SQL["knn_centroids"]
