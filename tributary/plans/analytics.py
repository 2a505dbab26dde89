"""Grouped, joined and summary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import scalars
from tributary.operators import grouping, stats
from tributary.plans import inputs
from tributary.plans.inputs import table
from tributary.sources import patents

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def q1_top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.top_groups(table(spark, sf_dir, "lineitem"), "l_suppkey", 10, "l_suppkey")


def q2_count_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.count_by(table(spark, sf_dir, "orders"), F.year("o_orderdate"), "o_year")


def q3_top_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.top_groups(table(spark, sf_dir, "part"), scalars.section_of(F.col("p_type")), 10, "section")


def q4_most_referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.top_groups(table(spark, sf_dir, "lineitem"), "l_partkey", 10, "l_partkey")


def q5_join_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    per_customer = grouping.joined_counts(lines, "l_orderkey", table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isNotNull())
    counts = grouping.joined_counts(per_customer, "o_custkey", customers, "c_custkey", "c_mktsegment", "c")
    return counts.orderBy(F.desc("c"), F.asc("c_mktsegment")).limit(10)


def summary_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.summary_by_source(inputs.docs(spark, sf_dir))


def json_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.field_counts(table(spark, sf_dir, "events"), "props", "$.k", "k")


def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.row_counts({name: table(spark, sf_dir, name) for name in TABLES})


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.latency_summary(table(spark, sf_dir, "events"), "event_type", "value")


def best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.best_of(table(spark, sf_dir, "events"), "event_type", "value")


def capture_overhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, views as runs without capture and clicks as runs with it."""
    mode = F.when(F.col("event_type") == "view", "off").when(F.col("event_type") == "click", "on")
    runs = (
        table(spark, sf_dir, "events").withColumn("mode", mode).filter(F.col("mode").isNotNull())
        .groupBy("user_id", "mode")
        .agg(F.max("value").alias("rate"), (F.count(F.lit(1)) * 100.0).alias("bytes"))
    )
    return stats.capture_overhead(runs, ["user_id"])


def docs_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = stats.docs_per_minute(table(spark, sf_dir, "events"), "ts", ["event_type"])
    return rates.select(
        "event_type", "n", F.round("event_window_s", 3).alias("event_window_s"),
        F.round("docs_per_min", 6).alias("docs_per_min"),
    )


def event_rate_1min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rate_per_window(table(spark, sf_dir, "events")).select("window_start", "n")


def hit_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and links of documents whose meta has a title only for English and no link for French."""
    english, french = F.col("lang") == "en", F.col("lang") == "fr"
    meta = F.to_json(
        F.struct(F.when(english, F.col("source")).alias("title"), F.when(~french, F.col("lang")).alias("url"))
    )
    hits = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", meta.alias("meta"))
    return grouping.hit_display(hits).select("id", "title", "url")


def id_and_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and texts for the embedder; texts of documents without a label are NULL and read as ``''``."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    marked = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    text = F.when(F.col("quality").isNotNull(), F.col("text")).alias("text")
    return patents.id_and_abstract(marked.select("doc_id", text), "doc_id", "text")


QUERIES = {
    f.__name__: f
    for f in (
        q1_top_groups, q2_count_by_year, q3_top_sections, q4_most_referenced, q5_join_count, summary_by_source,
        json_group_count, row_counts, latency_summary, best_of_n, capture_overhead, docs_per_minute,
        event_rate_1min, hit_display, id_and_text,
    )
}

SQL = {
    "q1_top_groups": """
        SELECT l_suppkey, count(*) AS c FROM lineitem WHERE l_suppkey IS NOT NULL
        GROUP BY l_suppkey ORDER BY c DESC, l_suppkey LIMIT 10""",
    "q2_count_by_year": """
        SELECT CAST(year(o_orderdate) AS INTEGER) AS o_year, count(*) AS c FROM orders
        GROUP BY 1 ORDER BY 1 NULLS FIRST""",
    "q3_top_sections": """
        SELECT substr(p_type, 1, 1) AS section, count(*) AS c FROM part WHERE p_type IS NOT NULL
        GROUP BY 1 ORDER BY c DESC, section LIMIT 10""",
    "q4_most_referenced": """
        SELECT l_partkey, count(*) AS c FROM lineitem WHERE l_partkey IS NOT NULL
        GROUP BY l_partkey ORDER BY c DESC, l_partkey LIMIT 10""",
    "q5_join_count": """
        SELECT c_mktsegment, count(*) AS c FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY c DESC, c_mktsegment LIMIT 10""",
    "summary_by_source": """
        SELECT coalesce(source, '?') AS source, count(*) AS c, (SELECT count(*) FROM documents) AS total
        FROM documents GROUP BY 1""",
    "json_group_count": """
        SELECT coalesce(json_extract_string(props, '$.k'), '?') AS k, count(*) AS c FROM events GROUP BY 1""",
    "row_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS c FROM {t}" for t in TABLES),
    "latency_summary": """
        SELECT event_type, count(value) AS n,
               round(list_sort(list(value))[CAST(floor(count(value) * 0.5::DOUBLE) AS BIGINT) + 1] * 1000.0::DOUBLE, 2) AS p50_ms,
               round(list_sort(list(value))[CAST(floor(count(value) * 0.95::DOUBLE) AS BIGINT) + 1] * 1000.0::DOUBLE, 2) AS p95_ms,
               round(avg(value) * 1000.0::DOUBLE, 2) AS mean_ms
        FROM events GROUP BY 1""",
    "best_of_n": """
        SELECT event_type, min(value) AS best, count(*) AS repeats FROM events GROUP BY 1""",
    "capture_overhead": """
        WITH r AS (
          SELECT user_id,
            max(value) FILTER (event_type = 'view') AS off_rate, max(value) FILTER (event_type = 'click') AS on_rate,
            count(*) FILTER (event_type = 'view') AS off_n, count(*) FILTER (event_type = 'click') AS on_n
          FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id)
        SELECT user_id,
          round(CASE WHEN off_rate > 0 THEN (off_rate - on_rate) / off_rate * 100.0::DOUBLE ELSE 0.0::DOUBLE END, 1)
            AS throughput_overhead_pct,
          round(CASE WHEN on_n > 0 THEN on_n * 100.0::DOUBLE END
                / greatest(CASE WHEN off_n > 0 THEN off_n * 100.0::DOUBLE END, 1.0::DOUBLE), 2) AS storage_amplification_x,
          round(CASE WHEN on_rate > 0 THEN off_rate / on_rate ELSE 0.0::DOUBLE END, 1) AS slower_x
        FROM r""",
    "docs_per_minute": """
        WITH s AS (
          SELECT event_type, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE AS w
          FROM events GROUP BY 1)
        SELECT event_type, n, round(w, 3) AS event_window_s,
               round(CASE WHEN w > 0 THEN n / w * 60.0::DOUBLE ELSE 0.0::DOUBLE END, 6) AS docs_per_min FROM s""",
    "event_rate_1min": """
        SELECT date_trunc('minute', ts) AS window_start, count(*) AS n FROM events GROUP BY 1""",
    "hit_display": """
        SELECT doc_id AS id, CASE WHEN lang = 'en' THEN source ELSE text END AS title,
               CASE WHEN lang = 'fr' THEN '' ELSE lang END AS url FROM documents""",
    "id_and_text": """
        SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN '' ELSE d.text END AS text
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
}
