"""The test tables in the roles the operators expect.

``documents`` plays the docs table, ``events`` the change log and the node logs, ``lineitem``,
``orders`` and ``part`` the star, ``conversations`` the outbox and ``benchmark`` the search queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import records
from tributary.operators import changes, embedding
from tributary.sources import star

DIM = 64
DOC_LOG = "docs"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table."""
    return star.read_table(spark, f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts: str) -> Column:
    """Seconds since 1970 of a time without zone, whatever the session's zone."""
    t = F.col(ts)
    days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86_400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text", F.to_json(F.struct("lang", "source")).alias("meta")
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a change log with full images: signup inserts, error deletes, the rest updates."""
    image = F.to_json(
        F.struct(
            F.col("user_id").cast("string").alias("id"),
            F.col("event_type").alias("text"),
            F.col("props").alias("meta"),
            epoch_seconds("ts").alias("ts"),
        )
    )
    code = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    images = {"before": F.when(code != 1, image), "after": F.when(code != -1, image)}
    return records.computed_once(table(spark, sf_dir, "events"), images).select(
        F.col("event_id").alias("change_id"),
        code.alias("change_type"),
        F.lit(DOC_LOG).alias("table_name"),
        "before",
        "after",
    )


def event_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.effects(changes.decode(event_log(spark, sf_dir)))


def middle_change(spark: SparkSession, sf_dir: str) -> Column:
    """The change id half way through the log, as a scalar subquery."""
    ids = table(spark, sf_dir, "events")
    return ids.agg(F.floor((F.min("event_id") + F.max("event_id")) / 2).alias("middle")).scalar()


# The same log in SQL; queries add their own steps behind it.
LOG_SQL = """
WITH log AS (
  SELECT event_id AS change_id,
         CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
         CAST(user_id AS VARCHAR) AS id, event_type AS text, props AS meta,
         CAST(floor(epoch(ts)) AS BIGINT) AS ts
  FROM events),
mid AS (SELECT CAST(floor((min(event_id) + max(event_id)) / 2) AS BIGINT) AS m FROM events),
last_all AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY change_id DESC) AS rn FROM log) WHERE rn = 1),
last_old AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY change_id DESC) AS rn
    FROM log WHERE change_id <= (SELECT m FROM mid)) WHERE rn = 1),
last_new AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY change_id DESC) AS rn
    FROM log WHERE change_id > (SELECT m FROM mid)) WHERE rn = 1)
"""


def text_vectors(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.select(F.col(key).alias(name), embedding.hash_vector(F.col("text"), DIM).alias("emb"))


def doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_vectors(table(spark, sf_dir, "documents"), "doc_id", "id")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_vectors(table(spark, sf_dir, "benchmark"), "item_id", "query_id")


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb"))


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, emb)``: the mean vector of each label, dimension by dimension."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))  # one entry per dimension
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(ordered, lambda p: p["x"].cast("float")).alias("emb")
    )


FOLD_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def embed_sql(name: str, source: str, key: str, dim: int = DIM) -> str:
    """CTEs ``{name}_b(id, bucket, n)`` and ``{name}(id, emb)``: the hashing embedder in SQL."""
    folded = FOLD_SQL.format("text")
    return f"""
{name}_t AS (SELECT {key} AS id, unnest(regexp_extract_all({folded}, '[a-z]+')) AS t FROM {source}),
{name}_b AS (
  SELECT id, CAST(('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} AS INTEGER) AS bucket, count(*) AS n
  FROM {name}_t GROUP BY 1, 2),
{name}_n AS (SELECT id, sqrt(sum(n * n)::DOUBLE) AS norm FROM {name}_b GROUP BY id),
{name} AS (
  SELECT k.id, list((coalesce(b.n / v.norm, 0.0))::FLOAT ORDER BY r.i) AS emb
  FROM (SELECT {key} AS id FROM {source}) k
  CROSS JOIN (SELECT unnest(range({dim})) AS i) r
  LEFT JOIN {name}_n v ON v.id = k.id
  LEFT JOIN {name}_b b ON b.id = k.id AND b.bucket = r.i
  GROUP BY k.id)"""


CENTROID_SQL = """
cent AS (
  SELECT query_id, list(x::FLOAT ORDER BY pos) AS emb FROM (
    SELECT label AS query_id, pos, avg(x::DOUBLE) AS x FROM (
      SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)
    GROUP BY label, pos) GROUP BY query_id)"""


def top_sql(corpus: str, queries: str, k: int) -> str:
    """CTE ``top(query_id, id, dist, rank)``: every pair scored, the best ``k`` per query kept."""
    return f"""
pairs AS (
  SELECT q.query_id, c.id,
         round(CASE WHEN list_sum(list_transform(c.emb, lambda x: abs(x))) = 0
                      OR list_sum(list_transform(q.emb, lambda x: abs(x))) = 0 THEN 1.0
                    ELSE list_cosine_distance(c.emb::DOUBLE[], q.emb::DOUBLE[]) END, 6) AS dist
  FROM {corpus} c CROSS JOIN {queries} q),
top AS (
  SELECT * FROM (
    SELECT query_id, id, dist + 0.0 AS dist,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS INTEGER) AS rank FROM pairs)
  WHERE rank <= {k})"""
