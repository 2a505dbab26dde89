"""Raw patent records, one JSON object per line, normalised into a star of three tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import records, scalars


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _not_blank(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"\s", " ")) != ""


def rejected_lines(lines: DataFrame) -> DataFrame:
    """The non-blank lines that are not JSON, for a quarantine table."""
    return lines.filter(_not_blank(F.col("value")) & records.parsed(F.col("value")).isNull())


def parse_lines(lines: DataFrame, limit: int | None = None, permissive: bool = False) -> DataFrame:
    """Typed records of ``lines`` (column ``value``).

    Blank lines and records without a ``patent_id`` are skipped and do not count towards ``limit``.
    A malformed line fails the job; with ``permissive`` it is left out (see :func:`rejected_lines`).
    """
    text = F.col("value")
    doc = F.col("doc")
    docs = records.computed_once(lines.filter(_not_blank(text)), {"doc": records.parsed(text)})
    if not permissive:
        docs = docs.withColumn("doc", records.checked(doc, text, "line"))
    kept = (
        records.computed_once(docs, {"patent_id": records.text_at(doc, "$.patent_id")})
        .filter(F.col("patent_id").isNotNull())
        .select(
            "patent_id",
            records.text_at(doc, "$.title").alias("title"),
            records.text_at(doc, "$.abstract").alias("abstract"),
            records.text_at(doc, "$.claims").alias("claims"),
            records.text_at(doc, "$.assignee").alias("assignee"),
            records.text_at(doc, "$.grant_date").alias("grant_date"),
            records.texts_at(doc, "$.cpc_codes").alias("cpc_codes"),
            records.texts_at(doc, "$.cited_patent_ids").alias("cited_ids"),
        )
    )
    return kept if limit is None else kept.limit(limit)


def distinct_codes(codes: Column) -> Column:
    return F.array_sort(F.array_distinct(codes))


def patents(raw: DataFrame) -> DataFrame:
    """The fact table: distinct codes and all citations (with repeats) are counted per patent."""
    return raw.select(
        "patent_id",
        "title",
        "abstract",
        "assignee",
        F.nullif(F.col("grant_date"), F.lit("")).alias("grant_date"),
        scalars.year_of(F.col("grant_date")).alias("grant_year"),
        scalars.byte_length(F.col("claims")).alias("claims_len"),
        F.size(F.array_distinct("cpc_codes")).alias("n_cpc"),
        F.size("cited_ids").alias("n_citations"),
    )


def patent_cpc(raw: DataFrame) -> DataFrame:
    """One row per distinct code of a patent."""
    return raw.select("patent_id", F.explode(distinct_codes(F.col("cpc_codes"))).alias("cpc")).select(
        "patent_id", "cpc", scalars.section_of(F.col("cpc")).alias("cpc_section")
    )


def patent_citations(raw: DataFrame) -> DataFrame:
    """One row per citation, repeats kept."""
    return raw.select("patent_id", F.explode("cited_ids").alias("cited_id"))


def id_and_abstract(patents_df: DataFrame, key: str = "patent_id", text: str = "abstract") -> DataFrame:
    """What the embedder needs of a table: its key and its text, NULL text as ``''``."""
    return patents_df.select(key, F.coalesce(text, F.lit("")).alias(text))
