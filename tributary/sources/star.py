"""Parquet tables: scan, register, bounded load, write."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tributary import schemas

STAR = {
    "patents": schemas.PATENTS,
    "patent_cpc": schemas.PATENT_CPC,
    "patent_citations": schemas.PATENT_CITATIONS,
}


class MissingTable(FileNotFoundError):
    """The folder or file of a table does not exist."""


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Scan Parquet at ``path``. With a schema no file is opened to infer one."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        return reader.parquet(path)
    except AnalysisException as failure:
        if failure.getCondition() == "PATH_NOT_FOUND":
            raise MissingTable(f"no table at {path}; generate or prepare the data first") from failure
        raise


def first_rows(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Up to ``limit`` rows of the table at ``path``; all of them when no limit is given."""
    rows = read_table(spark, path)
    return rows if limit is None else rows.limit(limit)


def register_star(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Make the three star tables under ``folder`` queryable by name in SQL."""
    tables = {}
    for name, schema in STAR.items():
        tables[name] = read_table(spark, f"{folder}/{name}.parquet", schema)
        tables[name].createOrReplaceTempView(name)
    return tables


def write_table(
    df: DataFrame, path: str, schema: T.StructType, rows_per_file: int = 5_000_000, mode: str = "overwrite"
) -> None:
    """Write ``df`` as Parquet after checking it against ``schema``; files roll at ``rows_per_file``."""
    (
        schemas.conform(df, schema)
        .write.mode(mode)
        .option("maxRecordsPerFile", rows_per_file)
        .parquet(path)
    )
