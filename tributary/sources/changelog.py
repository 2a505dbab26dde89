"""The change log as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary import schemas, tables


def read_changes(
    spark: SparkSession, path: str, table: str | None = None, after_id: int | None = None
) -> DataFrame:
    """Changes of ``table`` past ``after_id``. Both conditions reach the Parquet scan."""
    return changes_of(spark.read.schema(schemas.CHANGE_LOG).parquet(path), table, after_id)


def changes_of(log: DataFrame, table: str | None = None, after_id: int | None = None) -> DataFrame:
    if table is not None:
        log = log.filter(F.col("table_name") == table)
    if after_id is not None:
        log = log.filter(F.col("change_id") > after_id)
    return log


def write_changes(log: DataFrame, path: str, width: int = 1_000_000) -> None:
    """Append changes as a log in folders by table, in files by ranges of ``width`` change ids.

    A reader of one table opens its folder alone; within it, the ids in a file's footer rule out files before ``after_id``.
    A table with a large share of the changes is written by as many tasks as it has ranges.
    """
    ranges = F.floor(F.col("change_id") / width)
    ordered = schemas.conform(log, schemas.CHANGE_LOG).repartition("table_name", ranges).sortWithinPartitions("table_name", "change_id")
    ordered.write.mode("append").partitionBy("table_name").parquet(path)


def stream_versions(spark: SparkSession, path: str, versions_per_batch: int = 1000) -> DataFrame:
    """Committed versions of the log at ``path`` as a stream; what was written and not committed never shows."""
    log = tables.Versions(spark, path, schemas.CHANGE_LOG)
    return spark.readStream.schema(tables.COMMITS).option("maxFilesPerTrigger", versions_per_batch).parquet(log.commit_path)


def changes_in(spark: SparkSession, path: str, versions: list[int], table: str | None = None) -> DataFrame:
    """The changes of some versions of the log."""
    log = tables.Versions(spark, path, schemas.CHANGE_LOG).read_only(versions)
    return changes_of(log.drop("version"), table)
