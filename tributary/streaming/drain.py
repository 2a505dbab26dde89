"""Draining a change log into sinks, pruning it, and landing document feeds."""

from __future__ import annotations

import time
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tributary import schemas
from tributary.operators import changes
from tributary.sources import changelog
from tributary.streaming.sinks import Sink
from tributary.tables import Versions


class NoSink(ValueError):
    """A drain was asked for without any destination."""


@dataclass
class DrainStats:
    """What one drain did. ``seconds`` covers the whole run, start-up included."""

    changes: int = 0
    skipped: int = 0
    by_op: dict[str, int] = field(default_factory=lambda: {"insert": 0, "update": 0, "delete": 0})
    versions: list[int] = field(default_factory=list)
    seconds: float = 0.0

    @property
    def changes_per_second(self) -> float:
        return self.changes / self.seconds if self.seconds > 0 else 0.0


def change_versions(spark: SparkSession, path: str) -> Versions:
    return Versions(spark, path, schemas.CHANGE_LOG)


def append_changes(spark: SparkSession, log: DataFrame, path: str, version: int, tag: str | None = None) -> bool:
    """Add a batch of changes to the log at ``path`` as one version; False if it is there already."""
    return change_versions(spark, path).write(log, version, tag)


def fan_out(log: DataFrame, sinks: Sequence[Sink], version: int, key: str, strict: bool, stats: DrainStats) -> None:
    """Decode one batch once and apply it to every sink."""
    seen = Observation()
    code = F.col("change_type")
    decode = changes.decode_strict if strict else changes.decode
    decoded = decode(log.observe(seen, F.count(F.lit(1)).alias("n")), key).persist()
    try:
        counts = {row["op"]: row["c"] for row in changes.op_counts(decoded).collect()}
        for sink in sinks:
            sink.apply(decoded, version)
    finally:
        decoded.unpersist()
    for op, n in counts.items():
        stats.by_op[op] += n
    total = sum(counts.values())
    stats.changes += total
    stats.skipped += seen.get["n"] - total
    stats.versions.append(version)


def drain(
    spark: SparkSession,
    log_path: str,
    sinks: Iterable[Sink],
    checkpoint: str,
    table: str | None = None,
    key: str = "id",
    strict: bool = False,
    versions_per_batch: int = 1000,
) -> DrainStats:
    """Drain what the log holds now into all sinks and stop.

    The position is kept in ``checkpoint``: the next drain continues there, also after a failure, and
    a repeated micro-batch carries the same version, which sinks ignore. Keep one checkpoint per set
    of sinks.
    """
    sinks = list(sinks)
    if not sinks:
        raise NoSink("no sink configured; give at least one")
    stats = DrainStats()
    started = time.monotonic()

    def send(commits: DataFrame, batch: int) -> None:
        versions = [r["version"] for r in commits.collect()]  # at most ``versions_per_batch``
        fan_out(changelog.changes_in(spark, log_path, versions, table), sinks, batch, key, strict, stats)

    query = (
        changelog.stream_versions(spark, log_path, versions_per_batch)
        .writeStream.foreachBatch(send)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    stats.seconds = time.monotonic() - started
    return stats


def prune(spark: SparkSession, log_path: str, drained: Sequence[int]) -> int:
    """Delete log versions that every consumer has drained; ``drained`` has each one's newest log version."""
    return change_versions(spark, log_path).drop(min(drained)) if drained else 0


def land_documents(
    lines: DataFrame, to_documents, put, checkpoint: str, push_every: float | None = None
):
    """Stream landed text lines through ``to_documents`` into ``put(documents, version)``.

    Without ``push_every`` the stream takes what is there and stops; with it, it publishes every so
    many seconds until stopped. Returns the streaming query.
    """
    trigger = {"availableNow": True} if push_every is None else {"processingTime": f"{push_every} seconds"}
    return (
        to_documents(lines)
        .writeStream.foreachBatch(put)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
