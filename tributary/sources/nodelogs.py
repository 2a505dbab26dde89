"""Text logs of nodes, one file per node."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """``(node, file_ms, position, line)``: lines of every ``*.log`` under ``folder``.

    A node is named after its file. ``position`` orders the lines of a node: block offset in the file,
    then order inside the block.
    """
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.log$", "")
    return (
        spark.read.option("pathGlobFilter", "*.log")
        .text(folder)
        .select(
            name.alias("node"),
            F.col("_metadata.file_modification_time").alias("touched"),
            F.struct(
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("line"),
            ).alias("position"),
            F.col("value").alias("line"),
        )
    )


def last_per_node(lines: DataFrame, n: int, rank: str = "back") -> DataFrame:
    """The last ``n`` lines of each node. The rank limit cuts each task's lines before the shuffle."""
    newest_first = Window.partitionBy("node").orderBy(F.col("position").desc())
    return lines.withColumn(rank, F.row_number().over(newest_first)).filter(F.col(rank) <= n)


def tail(lines: DataFrame, n: int = 120, width: int | None = None) -> DataFrame:
    """The last ``n`` lines of each node, whole or cut to ``width`` characters; ``back`` = 1 is the newest."""
    last = last_per_node(lines, n)
    return last if width is None else last.withColumn("line", F.substring("line", 1, width))
