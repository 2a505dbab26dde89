"""Session settings, and the shared folder for data that outlives a stage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "tributary", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine. On a cluster use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Where the setting is absent a local session gets a temporary folder of its own; on a cluster a
    machine-local folder would be lost with its machine, so an absent setting is an error there.
    """
    context = spark.sparkContext
    key = "spark.checkpoint.dir"
    named = spark.conf.get(key, None) or context.getConf().get(key, None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tributary-")
    context.setCheckpointDir(folder)
    return folder


def written_once(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, for a costly step that several later steps read.

    Unlike cached data it is there after the loss of executors, and readers take the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/written/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
