"""Counts, joined counts, top-k reports and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_groups(df: DataFrame, key: str | Column, n: int = 10, name: str = "key") -> DataFrame:
    """The ``n`` most frequent non-NULL keys with their counts; equal counts are ordered by key."""
    column = F.col(key) if isinstance(key, str) else key
    counts = df.select(column.alias(name)).filter(F.col(name).isNotNull()).groupBy(name).agg(
        F.count(F.lit(1)).alias("c")
    )
    return counts.orderBy(F.desc("c"), F.asc(name)).limit(n)


def count_by(df: DataFrame, key: str | Column, name: str = "key") -> DataFrame:
    """Rows per key, NULL key first, ordered by key."""
    column = F.col(key) if isinstance(key, str) else key
    counts = df.select(column.alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("c"))
    return counts.orderBy(F.asc_nulls_first(name))


def joined_counts(
    facts: DataFrame, fact_key: str, dim: DataFrame, dim_key: str, group: str, weight: str | None = None
) -> DataFrame:
    """Rows of ``facts ⋈ dim`` per ``dim.group`` as ``(group, c)``.

    Facts are counted per join key before the join: a key that holds a large share of the facts is
    one row by then, and the shuffle of the join moves keys instead of facts. ``weight`` names a count
    column of ``facts`` that already stands for several rows.
    """
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    per_key = facts.groupBy(F.col(fact_key).alias("_key")).agg(amount.alias("_n"))
    members = dim.select(F.col(dim_key).alias("_key"), F.col(group))
    return per_key.join(members, "_key").groupBy(group).agg(F.sum("_n").alias("c"))


def top_joined(
    facts: DataFrame, fact_key: str, dim: DataFrame, dim_key: str, group: str, n: int = 10
) -> DataFrame:
    """The ``n`` groups of ``dim`` with most joined facts, NULL group left out."""
    counts = joined_counts(facts, fact_key, dim.filter(F.col(group).isNotNull()), dim_key, group)
    return counts.orderBy(F.desc("c"), F.asc(group)).limit(n)


def field_counts(df: DataFrame, json_column: str, path: str, name: str) -> DataFrame:
    """Rows per value of a JSON field; rows without the field count under ``'?'``."""
    field = F.coalesce(F.get_json_object(json_column, path), F.lit("?"))
    return df.select(field.alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("c"))


def summary_by_source(docs: DataFrame) -> DataFrame:
    """Documents per ``meta.source``, most frequent first, with the grand total on every row.

    The total is summed from the small grouped result, not from the documents.
    """
    counts = field_counts(docs, "meta", "$.source", "source")
    total = counts.agg(F.sum("c").alias("total"))
    return counts.withColumn("total", total.scalar()).orderBy(F.desc("c"), F.asc("source"))


def hit_display(hits: DataFrame) -> DataFrame:
    """Adds ``title`` (the text where meta has none) and ``url`` (``''`` where meta has none)."""
    return hits.withColumns(
        {
            "title": F.coalesce(F.get_json_object("meta", "$.title"), F.col("text")),
            "url": F.coalesce(F.get_json_object("meta", "$.url"), F.lit("")),
        }
    )
