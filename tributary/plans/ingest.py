"""Normalising raw records and landing feeds.

Raw lines are made from the test tables by Spark, one per row, with the flaws a feed has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import records
from tributary.plans.inputs import table
from tributary.sources import feeds, patents


def _raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw patent records: Spanish ones lack the key, German ones the assignee."""
    lang = F.col("lang")
    year = F.when(F.col("n_chars") < 1000, F.lit("20x0-01-01")).when(
        F.col("n_chars") < 10_000, F.concat(F.col("n_chars").cast("string"), F.lit("-01-01"))
    )
    record = F.struct(
        F.when(lang != "es", F.concat(F.lit("P"), "doc_id")).alias("patent_id"),
        F.col("source").alias("title"),
        F.col("text").alias("abstract"),
        F.when(lang != "de", F.col("source")).alias("assignee"),
        F.when(lang != "fr", F.col("text")).alias("claims"),
        year.alias("grant_date"),
        F.split("text", " ").alias("cpc_codes"),
        F.split("text", "\n").alias("cited_patent_ids"),
    )
    return _lines(table(spark, sf_dir, "documents"), F.to_json(record))


def _lines(df: DataFrame, line: Column) -> DataFrame:
    """Lines as a text file would hold them: made once, not again wherever they are read."""
    return records.computed_once(df, {"value": line}).select("value")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patents.parse_lines(_raw_lines(spark, sf_dir))


def prep_patents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patents.patents(_raw(spark, sf_dir))


def prep_cpc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patents.patent_cpc(_raw(spark, sf_dir))


def prep_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patents.patent_citations(_raw(spark, sf_dir))


def _json_line(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields))


def firehose_lines(spark: SparkSession, sf_dir: str, unnamed: str = "fr") -> DataFrame:
    """Documents as lines of edit events.

    German ones are of another type, those in the language ``unnamed`` have no event id, Spanish ones a namespace of the
    wrong JSON type; lines of one source are malformed and those of another lack the prefix.
    """
    lang, source = F.col("lang"), F.col("source")
    meta = F.struct(
        F.when(lang != unnamed, F.concat(F.lit("e"), "doc_id")).alias("id"),
        F.when(source != "src1", F.concat(F.lit("http://"), "source")).alias("uri"),
    )
    common = [
        F.when(lang == "de", "log").otherwise("edit").alias("type"),
        F.lit("enwiki").alias("wiki"),
        F.when(source == "src2", "").otherwise(source).alias("title"),
        F.col("text").alias("comment"),
        meta.alias("meta"),
    ]
    number = _json_line(F.lit(0).alias("namespace"), *common)
    word = _json_line(F.lit("0").alias("namespace"), *common)
    event = F.when(lang == "es", word).otherwise(number)
    line = (
        F.when(source == "src3", F.concat(F.lit("data: "), F.substring(event, 2, 1 << 30)))
        .when(source == "src4", F.concat(F.lit("event: "), event))
        .otherwise(F.concat(F.lit("data: "), event, F.lit("  ")))
    )
    return _lines(table(spark, sf_dir, "documents"), line)


def firehose_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as edit events, filtered to one wiki and namespace."""
    found = feeds.edit_documents(firehose_lines(spark, sf_dir), wiki="enwiki", namespace="0")
    return found.select(
        "id", "text", F.get_json_object("meta", "$.title").alias("title"), F.get_json_object("meta", "$.url").alias("url")
    )


def stories_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stories: Spanish ones without title, German ones without body, French ones without link."""
    lang = F.col("lang")
    line = _json_line(
        F.col("doc_id").alias("id"),
        F.when(lang == "es", "").otherwise(F.col("source")).alias("title"),
        F.when(lang != "de", F.col("text")).alias("text"),
        F.when(lang != "fr", F.concat(F.lit("http://"), "source")).alias("url"),
    )
    lines = _lines(table(spark, sf_dir, "documents"), line)
    return feeds.story_documents(lines).select("id", "text", F.get_json_object("meta", "$.url").alias("url"))


QUERIES = {
    f.__name__: f
    for f in (
        prep_patents, prep_cpc, prep_citations, firehose_docs, stories_docs,
    )
}

_KEPT = "FROM documents WHERE lang <> 'es'"

SQL = {
    "prep_patents": f"""
        SELECT 'P' || doc_id AS patent_id, source AS title, text AS abstract,
          CASE WHEN lang <> 'de' THEN source END AS assignee,
          CASE WHEN n_chars < 1000 THEN '20x0-01-01' WHEN n_chars < 10000 THEN n_chars || '-01-01' END AS grant_date,
          CASE WHEN n_chars >= 1000 AND n_chars < 10000 THEN CAST(n_chars AS INTEGER) END AS grant_year,
          CASE WHEN lang = 'fr' THEN 0 ELSE CAST(strlen(text) AS INTEGER) END AS claims_len,
          CAST(len(list_distinct(list_filter(string_split(text, ' '), lambda x: x <> ''))) AS INTEGER) AS n_cpc,
          CAST(len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS INTEGER) AS n_citations {_KEPT}""",
    "prep_cpc": f"""
        SELECT patent_id, cpc, substr(cpc, 1, 1) AS cpc_section FROM (
          SELECT 'P' || doc_id AS patent_id,
                 unnest(list_distinct(list_filter(string_split(text, ' '), lambda x: x <> ''))) AS cpc {_KEPT})""",
    "prep_citations": f"""
        SELECT 'P' || doc_id AS patent_id,
               unnest(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS cited_id {_KEPT}""",
    "firehose_docs": """
        SELECT CASE WHEN lang = 'fr' THEN 'enwiki:' || source ELSE 'e' || doc_id END AS id,
               source || ': ' || text AS text, source AS title,
               CASE WHEN source = 'src1' THEN '' ELSE 'http://' || source END AS url
        FROM documents WHERE lang NOT IN ('de', 'es') AND source NOT IN ('src2', 'src3', 'src4')""",
    "stories_docs": """
        SELECT 'hn:' || doc_id AS id, source || '. ' || CASE WHEN lang = 'de' THEN '' ELSE text END AS text,
               CASE WHEN lang = 'fr' THEN 'https://news.ycombinator.com/item?id=' || doc_id
                    ELSE 'http://' || source END AS url
        FROM documents WHERE lang <> 'es' AND source <> ''""",
}
