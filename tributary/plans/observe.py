"""Node logs made from ``events``: one node per user, one line per event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import telemetry
from tributary.plans.inputs import table
from tributary.sources import nodelogs


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    shown = value.cast("string")
    failure = (
        F.when(value < 10, F.concat(F.lit("  put failed (skipping "), "event_id", F.lit(")")))
        .when(value < 50, F.lit("  push failed: timeout"))
        .otherwise(F.lit("  wikimedia stream dropped: eof; reconnecting in 3s"))
    )
    line = (
        F.when(
            kind == "purchase",
            F.concat(F.lit("  stored="), "event_id", F.lit("  rate="), shown, F.lit("/s  (pushed)")),
        )
        .when(kind == "click", F.concat(F.lit("[retrieval] scan "), shown, F.lit("ms  embed 3.0ms")))
        .when(kind == "view", F.concat(F.lit("pulled changed="), (value > 30).cast("string")))
        .when(kind == "signup", F.concat(F.lit("source="), "props"))
        .otherwise(failure)
    )
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("node-"), "user_id").alias("node"),
        F.col("event_id").alias("position"),
        F.col("ts").alias("touched"),
        line.alias("line"),
    )


def log_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.node_metrics(_lines(spark, sf_dir))


def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 lines of each node."""
    return nodelogs.tail(_lines(spark, sf_dir), 20).select("node", "position", "line", "back")


def log_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 5 error lines of each node."""
    return telemetry.error_lines(_lines(spark, sf_dir), 5).select("node", "position", "line", "back")


def log_line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.line_classes(_lines(spark, sf_dir))


def node_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose newest line is less than 30 s older than the newest line of all."""
    lines = _lines(spark, sf_dir)
    newest = lines.agg(F.max("touched").alias("now")).scalar()
    return telemetry.node_up(lines, newest)


def fleet_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fleet: nodes that pushed more often than they searched are masters."""
    lines = _lines(spark, sf_dir)
    classes = telemetry.line_classes(lines).filter(F.col("class") == "err")
    errors = classes.select("node", F.col("c").alias("errors"))
    metrics = telemetry.node_metrics(lines).join(errors, "node", "left").fillna(0, ["errors"])
    role = F.when(F.col("pushed_batches") > F.col("searches"), "master").otherwise("replica")
    return telemetry.fleet_rollup(
        metrics.withColumn("role", role).withColumn("up", F.col("last_pull_changed") == "true")
    )


QUERIES = {f.__name__: f for f in (log_metrics, log_tail, log_errors, log_line_classes, node_up, fleet_rollup)}

# Written against the events, not the lines, so the patterns that read the lines are checked too.
_LINES = """
WITH l AS (
  SELECT 'node-' || user_id AS node, event_id, event_type, value, props, ts,
    CASE event_type
      WHEN 'purchase' THEN '  stored=' || event_id || '  rate=' || value || '/s  (pushed)'
      WHEN 'click' THEN '[retrieval] scan ' || value || 'ms  embed 3.0ms'
      WHEN 'view' THEN 'pulled changed=' || CASE WHEN value > 30 THEN 'true' ELSE 'false' END
      WHEN 'signup' THEN 'source=' || props
      ELSE CASE WHEN value < 10 THEN '  put failed (skipping ' || event_id || ')'
                WHEN value < 50 THEN '  push failed: timeout'
                ELSE '  wikimedia stream dropped: eof; reconnecting in 3s' END END AS line
  FROM events),
m AS (
  SELECT node,
    coalesce(max(event_id) FILTER (event_type = 'purchase'), 0) AS stored,
    coalesce(max_by(value, event_id) FILTER (event_type = 'purchase'), 0.0::DOUBLE) AS rate_per_s,
    count(*) FILTER (event_type = 'purchase') AS pushed_batches,
    count(*) FILTER (event_type = 'error' AND value >= 10 AND value < 50) AS push_failed,
    count(*) FILTER (event_type = 'error' AND value < 10) AS put_failed,
    count(*) FILTER (event_type = 'error' AND value >= 50) AS reconnects,
    coalesce(max_by('source=' || props, event_id) FILTER (event_type = 'signup'), '') AS source,
    count(*) FILTER (event_type = 'click') AS searches,
    max_by(value, event_id) FILTER (event_type = 'click') AS last_retrieval_ms,
    max_by(CASE WHEN value > 30 THEN 'true' ELSE 'false' END, event_id) FILTER (event_type = 'view')
      AS last_pull_changed,
    count(*) FILTER (event_type = 'error') AS errors
  FROM l GROUP BY node)
"""

SQL = {
    "log_metrics": f"{_LINES} SELECT * EXCLUDE (errors) FROM m",
    "log_tail": f"""{_LINES}
        SELECT node, event_id AS position, line, back FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY node ORDER BY event_id DESC) AS INTEGER) AS back FROM l)
        WHERE back <= 20""",
    "log_errors": f"""{_LINES}
        SELECT node, event_id AS position, line, back FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY node ORDER BY event_id DESC) AS INTEGER) AS back
          FROM l WHERE event_type = 'error') WHERE back <= 5""",
    "log_line_classes": f"""{_LINES}
        SELECT node, CASE WHEN event_type = 'error' THEN 'err' WHEN event_type IN ('purchase', 'click') THEN 'ok'
                          ELSE '' END AS class, count(*) AS c FROM l GROUP BY 1, 2""",
    "node_up": f"""{_LINES}
        SELECT node, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) < 30000000 AS up
        FROM l GROUP BY node""",
    "fleet_rollup": f"""{_LINES},
        r AS (SELECT *, CASE WHEN pushed_batches > searches THEN 'master' ELSE 'replica' END AS role,
                     last_pull_changed = 'true' AS up FROM m),
        s AS (
          SELECT count(*) FILTER (role = 'master') AS masters, count(*) FILTER (role = 'replica') AS replicas,
            CAST(coalesce(sum(searches) FILTER (role = 'replica'), 0) AS BIGINT) AS searches,
            coalesce(bool_or(up), FALSE) AS any_up,
            coalesce(bool_or(up) FILTER (role = 'replica'), FALSE) AS replica_up,
            coalesce(bool_or(errors > 0), FALSE) AS any_error,
            max_by(last_retrieval_ms, node) FILTER (role = 'replica' AND last_retrieval_ms IS NOT NULL)
              AS last_retrieval_ms,
            coalesce(min_by(pushed_batches, node) FILTER (role = 'master'), 0) AS pushed_batches,
            coalesce(min_by(push_failed, node) FILTER (role = 'master'), 0) AS push_failed
          FROM r)
        SELECT *, CASE WHEN masters = 0 THEN 'no master' WHEN push_failed > 0 THEN 'pushes failing'
                       WHEN replicas = 0 THEN 'no replica'
                       WHEN pushed_batches > 0 AND searches > 0 THEN 'healthy'
                       WHEN pushed_batches > 0 THEN 'no searches yet' ELSE 'not pushing yet' END AS verdict,
                  CASE WHEN masters = 0 THEN 'bad'
                       WHEN push_failed = 0 AND replicas > 0 AND pushed_batches > 0 AND searches > 0 THEN 'ok'
                       ELSE 'warn' END AS level
        FROM s""",
}
