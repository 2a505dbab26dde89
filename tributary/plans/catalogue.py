"""All named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tributary.plans import analytics, feeds, ingest, movement, observe, retrieval

Query = Callable[[SparkSession, str], DataFrame]

_PARTS = (analytics, feeds, retrieval, ingest, observe, movement)


def queries() -> dict[str, Query]:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
