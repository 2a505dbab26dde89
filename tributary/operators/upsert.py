"""A table kept by key in bucket folders, into which a batch of changes is merged by one Spark job.

A bucket is a partition folder of a hash of the key. A merge reads the folders that the batch touches, folds old rows and
batch per key, and overwrites those folders alone, so cost follows the touched part of the table and no other
files are needed beside the rows: no deltas, no list of versions. Rows carry the number of their last change;
merging a batch again, or an older one late, changes nothing, and a deleted key stays as a tombstone for that reason.

Folders are staged by the tasks and put in place when the job ends, so lost executors and failed jobs leave the table
as it was. Spark puts them in place one after another: if the driver itself is lost in that moment, the remaining
folders are in the staging folder beside them. One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.operators import changes

BUCKET = "_bucket"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


class BucketTable:
    """Rows ``(key, change number, op, ...)`` of ``schema`` under ``path``; ``buckets`` stays as the table was made.

    A bucket is written by ``files`` tasks: a large table needs many buckets or files, so that a task's part is small.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, buckets: int = 64, files: int = 1, key: str = "id", order: str = "change_id"):
        self.spark, self.path, self.schema = spark, path, schema
        self.buckets, self.files, self.key, self.order = buckets, files, key, order

    def state(self) -> DataFrame | None:
        """All rows, tombstones included, with their bucket; None before the first merge."""
        schema = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as failure:
            if failure.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def rows(self) -> DataFrame:
        state = self.state()
        return self.spark.createDataFrame([], self.schema) if state is None else changes.live(state).drop(BUCKET)

    def touched(self, batch: DataFrame) -> list[int]:
        """The buckets of a batch: a list of at most ``buckets`` numbers."""
        return [r["b"] for r in batch.select(bucket_of(self.key, self.buckets).alias("b")).distinct().collect()]

    def merge(self, batch: DataFrame) -> None:
        """Merge changes with the columns of ``schema``; of several changes of a key the last one counts."""
        columns = self.schema.fieldNames()
        batch = batch.select(*columns)
        wanted = self.touched(batch)
        if not wanted:
            return
        state = self.state()
        old = state.where(F.col(BUCKET).isin(wanted)).select(*columns) if state is not None else batch.limit(0)
        self._write(changes.upsert_into(old, batch, self.key, self.order))

    def _write(self, rows: DataFrame) -> None:
        placed = rows.withColumn(BUCKET, bucket_of(self.key, self.buckets))
        file = F.pmod(F.xxhash64(F.lit(1), F.col(self.key)), F.lit(self.files))
        writer = placed.repartition(BUCKET, file).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(BUCKET).parquet(self.path)
