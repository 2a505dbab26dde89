"""Node metrics read from log lines, and their rollup over a fleet.

Input is ``(node, position, line)``; ``position`` orders a node's lines. Everything is a grouped
aggregate, so a node with very many lines is reduced in every task that reads some of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions import scalars
from tributary.sources import nodelogs

# What the metrics look for in a line.
STORED = r"stored=(\d+)"
RATE = r"rate=([\d.]+)/s"
RETRIEVAL = r"\[retrieval\]\s*(?:scan\s*)?([\d.]+)\s*ms"
PULLED = r"pulled changed=(\w+)"
RECENT_ERRORS = 40
UP_SECONDS = 30


def _found(pattern: str) -> Column:
    """What the pattern captures, NULL where the line does not match."""
    return F.get(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)), 0)


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _last(value: Column) -> Column:
    """The newest non-NULL value."""
    return F.max_by(value, F.when(value.isNotNull(), F.col("position")))


def node_metrics(lines: DataFrame) -> DataFrame:
    """One row per node: progress, failures, searches and the newest value of each gauge."""
    line = F.col("line")
    read = lines.withColumns(
        {
            "_pushed": line.contains("(pushed)"),
            "_stored": _found(STORED).cast("bigint"),
            "_rate": _found(RATE).cast("double"),
            "_retrieval": _found(RETRIEVAL).cast("double"),
            "_pulled": _found(PULLED),
        }
    )
    pushed, retrieval = F.col("_pushed"), F.col("_retrieval")
    return read.groupBy("node").agg(
        F.coalesce(F.max(F.when(pushed, F.col("_stored"))), F.lit(0)).alias("stored"),
        F.coalesce(_last(F.when(pushed, F.col("_rate"))), F.lit(0.0)).alias("rate_per_s"),
        _count(pushed).alias("pushed_batches"),
        _count(line.contains("push failed")).alias("push_failed"),
        _count(line.contains("put failed")).alias("put_failed"),
        _count(line.contains("reconnecting")).alias("reconnects"),
        F.coalesce(_last(F.when(line.startswith("source="), F.trim(line))), F.lit("")).alias("source"),
        _count(retrieval.isNotNull()).alias("searches"),
        _last(retrieval).alias("last_retrieval_ms"),
        _last(F.col("_pulled")).alias("last_pull_changed"),
    )


def error_lines(lines: DataFrame, n: int = RECENT_ERRORS) -> DataFrame:
    """The last ``n`` error lines of each node; ``back`` = 1 is the newest."""
    return nodelogs.tail(lines.filter(F.col("line").rlike(scalars.ERROR_LINE)), n)


def line_classes(lines: DataFrame) -> DataFrame:
    """Lines per node and class."""
    return lines.groupBy("node", scalars.line_class(F.col("line")).alias("class")).agg(
        F.count(F.lit(1)).alias("c")
    )


def node_up(lines: DataFrame, now: Column) -> DataFrame:
    """``(node, up)``: a node is up if its log was touched within the last seconds (column ``touched``)."""
    recent = (now - F.max("touched")) < F.make_dt_interval(secs=F.lit(UP_SECONDS))
    return lines.groupBy("node").agg(recent.alias("up"))


def fleet_rollup(metrics: DataFrame) -> DataFrame:
    """One row over ``(node, role, up, errors, …node metrics)`` with a verdict; the first rule that holds wins.

    Push figures are those of the first master by name; the last retrieval is that of the last
    replica by name that has one.
    """
    master, replica = F.col("role") == "master", F.col("role") == "replica"

    def lead(column: str) -> Column:
        return F.coalesce(F.min_by(column, F.when(master, F.col("node"))), F.lit(0)).alias(column)

    last = F.col("last_retrieval_ms")
    summary = metrics.agg(
        _count(master).alias("masters"),
        _count(replica).alias("replicas"),
        F.coalesce(F.sum(F.when(replica, F.col("searches"))), F.lit(0)).alias("searches"),
        F.coalesce(F.bool_or("up"), F.lit(False)).alias("any_up"),
        F.coalesce(F.bool_or(F.when(replica, F.col("up"))), F.lit(False)).alias("replica_up"),
        F.coalesce(F.bool_or(F.col("errors") > 0), F.lit(False)).alias("any_error"),
        F.max_by(last, F.when(replica & last.isNotNull(), F.col("node"))).alias("last_retrieval_ms"),
        lead("pushed_batches"),
        lead("push_failed"),
    )
    verdict = (
        F.when(F.col("masters") == 0, "no master")
        .when(F.col("push_failed") > 0, "pushes failing")
        .when(F.col("replicas") == 0, "no replica")
        .when((F.col("pushed_batches") > 0) & (F.col("searches") > 0), "healthy")
        .when(F.col("pushed_batches") > 0, "no searches yet")
        .otherwise("not pushing yet")
    )
    level = (
        F.when(F.col("verdict") == "no master", "bad").when(F.col("verdict") == "healthy", "ok").otherwise("warn")
    )
    return summary.withColumn("verdict", verdict).withColumn("level", level)
