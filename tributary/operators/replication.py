"""Replicas of a merged table: first a copy, then increments, then a check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators import changes


def snapshot(effects: DataFrame, upto: int) -> DataFrame:
    """State after all changes with ``change_id <= upto``, tombstones included."""
    return changes.fold(effects.filter(F.col("change_id") <= upto))


def increment(effects: DataFrame, after: int, upto: int | None = None) -> DataFrame:
    """The last change per key past ``after``: what a replica at ``after`` has to fetch."""
    newer = effects.filter(F.col("change_id") > after)
    return changes.fold(newer if upto is None else newer.filter(F.col("change_id") <= upto))


def catch_up(replica: DataFrame, delta: DataFrame) -> DataFrame:
    return changes.upsert_into(replica, delta)


def convergence(master: DataFrame, replica: DataFrame) -> DataFrame:
    """Row counts of both sides and whether their rows are the same."""
    return changes.same_content(changes.live(master), changes.live(replica)).withColumnsRenamed(
        {"left_rows": "master_rows", "right_rows": "replica_rows", "consistent": "converged"}
    )
