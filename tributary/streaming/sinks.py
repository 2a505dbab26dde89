"""Destinations of a drained change feed.

A sink has ``apply(decoded, version)``: ``decoded`` is a micro-batch of decoded changes and
``version`` its number. Applying the same version again must leave the sink as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tributary import schemas
from tributary.operators import changes
from tributary.tables import MergeTable, Versions


class Sink(Protocol):
    def apply(self, decoded: DataFrame, version: int) -> None: ...


class StrictViolation(RuntimeError):
    """A strict table was sent an insert on a live key."""


class UpsertSink:
    """Keeps the last image per key; an insert on a live key replaces it."""

    def __init__(self, table: MergeTable):
        self.table = table

    def apply(self, decoded: DataFrame, version: int) -> None:
        self.table.apply(self.table.typed(changes.effects(decoded)), version)

    def documents(self) -> DataFrame:
        return self.table.rows().drop("change_id", "op")


class StrictSink(UpsertSink):
    """Like :class:`UpsertSink`, but a batch with an insert on a live key is refused as a whole."""

    def apply(self, decoded: DataFrame, version: int) -> None:
        if self.table.version() >= version:
            return
        stored = self.table.touching(changes.effects(decoded))
        refused = changes.violations(decoded, stored).filter(F.col("reason") == changes.TWICE)
        first = refused.orderBy("change_id").limit(5).collect()
        if first:
            raise StrictViolation("; ".join(f"change {r.change_id}: {r.reason} {r.id!r}" for r in first))
        super().apply(decoded, version)


LAKE_ROWS = schemas.struct("change_id bigint, op string, id string, image string")


class LakeSink:
    """Appends every insert and update image, one folder per version; deletes are not applied."""

    def __init__(self, spark: SparkSession, path: str, rows_per_file: int = 5_000_000):
        self.versions = Versions(spark, path, LAKE_ROWS, rows_per_file=rows_per_file)

    def apply(self, decoded: DataFrame, version: int) -> None:
        self.versions.write(changes.lake_rows(decoded), version)

    def rows(self) -> DataFrame:
        return self.versions.read().drop("version")


class IcebergSink:
    """The same append into a catalog table, for sessions that have an Iceberg catalog configured."""

    def __init__(self, table: str):
        self.table = table

    def apply(self, decoded: DataFrame, version: int) -> None:
        rows = changes.lake_rows(decoded).withColumn("version", F.lit(version).cast("bigint"))
        spark = rows.sparkSession
        if not spark.catalog.tableExists(self.table):
            rows.limit(0).writeTo(self.table).using("iceberg").partitionedBy("version").create()
        rows.writeTo(self.table).overwritePartitions()


class JsonlSink:
    """A change feed in text: one JSON event per line, one folder per version."""

    def __init__(self, spark: SparkSession, path: str):
        self.versions = Versions(spark, path, schemas.struct("value string"), kind="text")

    def apply(self, decoded: DataFrame, version: int) -> None:
        self.versions.write(changes.change_events(decoded), version)

    def lines(self) -> DataFrame:
        return self.versions.read().drop("version")


class DeliverSink:
    """Hands every event to ``deliver(json_text)``; an exception fails the batch.

    Events of one key are delivered in change order by one task, streamed and never gathered; a
    micro-batch bounds how many there are. With ``ordered=False`` events are spread evenly instead,
    for receivers that order by change id themselves. A retried task delivers again.
    """

    def __init__(self, deliver: Callable[[str], None], ordered: bool = True):
        self.deliver, self.ordered = deliver, ordered
        self.sent = 0

    def apply(self, decoded: DataFrame, version: int) -> None:
        events = changes.change_events(decoded)
        if self.ordered:
            events = events.repartition("id").sortWithinPartitions("change_id")
        counter = decoded.sparkSession.sparkContext.accumulator(0)
        deliver = self.deliver

        def send(rows: Iterator[Row]) -> None:
            n = 0
            for row in rows:
                deliver(row.value)
                n += 1
            counter.add(n)

        events.foreachPartition(send)
        self.sent += counter.value


class ShadowSink:
    """Capture by hand: the rows of an insert-only batch, each with its version and operation."""

    def __init__(self, spark: SparkSession, path: str):
        self.versions = Versions(spark, path, None)

    def apply(self, batch: DataFrame, version: int) -> None:
        self.versions.write(changes.capture_inserts(batch, version).drop("version"), version)

    def rows(self) -> DataFrame:
        return self.versions.read()
