"""Ordered delivery with a durable prefix: what a receiver has taken is remembered per key, and a refused event keeps the
rest of its key waiting.

Events of a key go out in the order of their numbers. A key with very many events is cut into stretches, and a round sends
one stretch of every key, each in one task; after the round its acknowledgements are a table of their own. Stretches are
counted within their key, so the rounds are as many as the longest key needs, however many keys there are; what waits is
laid out by round once, and a round reads its own events only.
A run that failed, or found its receiver refusing, is repeated: it goes on behind what was acknowledged. A task that
is run again sends its stretch again, so receivers must take an event twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.session import shared_dir

WIDTH = 100_000  # events of a stretch; as many numbers are counted together, so one may have twice as many


def _acks_schema(events: DataFrame) -> str:
    return f"key {events.schema['key'].dataType.simpleString()}, seq bigint, sent bigint, refused boolean"


class Delivery:
    """Delivers ``events(key, seq, value)`` with ``send(key, seq, value) -> bool``; acknowledgements lie under ``path``.

    ``send`` runs in the tasks. A false answer or an exception refuses the event. ``seq`` is unique within a key.
    """

    def __init__(self, spark: SparkSession, path: str, send: Callable[[object, int, str], bool], width: int = WIDTH):
        self.spark, self.path, self.send, self.width = spark, path, send, width

    def acknowledged(self, schema: str) -> DataFrame:
        """``(key, seq, sent)``: the last number a key's receiver has taken, and how many in all."""
        try:
            rounds = self.spark.read.schema(schema).parquet(f"{self.path}/acks")
        except AnalysisException as failure:
            if failure.getCondition() != "PATH_NOT_FOUND":
                raise
            rounds = self.spark.createDataFrame([], schema)
        return rounds.groupBy("key").agg(F.max("seq").alias("seq"), F.sum("sent").cast("bigint").alias("sent"))

    def run(self, events: DataFrame) -> None:
        """Send what is not acknowledged yet, round by round, until every key has ended or refused an event."""
        schema = _acks_schema(events)
        run_id = uuid.uuid4().hex
        done = self.acknowledged(schema).select("key", F.col("seq").alias("_done"))
        left = events.join(done, "key", "left").where(F.col("_done").isNull() | (F.col("seq") > F.col("_done")))
        waiting = self._by_round(left.select("key", F.col("seq").cast("bigint").alias("seq"), "value"))
        numbers = sorted(r["round"] for r in waiting.select("round").distinct().collect())  # as many as the longest key has stretches
        for number in numbers:
            part = waiting.where(F.col("round") == number)
            if number != numbers[0]:  # keys that refused an event earlier in this run wait
                stopped = self.spark.read.schema(f"{schema}, run string").parquet(f"{self.path}/acks").where((F.col("run") == run_id) & F.col("refused"))
                part = part.join(stopped.select("key"), "key", "left_anti")
            ordered = part.select("key", "seq", "value").repartition("key").sortWithinPartitions("key", "seq")
            acks = ordered.mapInArrow(_sender(self.send), schema)
            acks.withColumn("run", F.lit(run_id)).write.mode("append").parquet(f"{self.path}/acks")

    def _by_round(self, left: DataFrame) -> DataFrame:
        """``left`` with the ``round`` that sends each event, as a table with a folder per round.

        Only keys with more than ``width`` events are cut. Their events are counted by ranges of numbers, so that no task
        has to number all events of a key.
        """
        cell = F.floor(F.col("seq") / self.width)
        long = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > self.width).select("key")
        counts = left.join(long, "key", "left_semi").groupBy("key", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cut = counts.select("key", "cell", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / self.width).alias("round"))
        placed = left.withColumn("cell", cell).join(cut, ["key", "cell"], "left")
        placed = placed.select("key", "seq", "value", F.coalesce("round", F.lit(0)).cast("bigint").alias("round"))
        path = f"{shared_dir(self.spark)}/written/{uuid.uuid4().hex}"
        placed.repartition("round", "key").write.partitionBy("round").parquet(path)
        return self.spark.read.schema(placed.schema).parquet(path)


def _sender(send: Callable[[object, int, str], bool]):
    def taken(key: object, seq: int, value: str) -> bool:
        try:
            return bool(send(key, seq, value))
        except Exception:  # a refused event stays queued, whatever the reason
            return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per key of the sorted events: the last number taken (null: none), how many, and whether one was refused."""
        now: list | None = None
        for batch in batches:
            told, kind = [], batch.schema.field(0).type
            for key, seq, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if now is None or key != now[0]:
                    told += [now] if now else []
                    now = [key, None, 0, False]
                if now[3]:
                    continue
                if taken(key, seq, value):
                    now[1], now[2] = seq, now[2] + 1
                else:
                    now[3] = True
            yield _rows(told, kind)
        if now:
            yield _rows([now], kind)

    def _rows(told: list[list], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.int64(), pa.bool_()]
        columns = list(zip(*told)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "seq", "sent", "refused"])

    return run
