"""Change feeds, replicas, write-back and the streaming drain."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import scalars
from tributary.operators import changes, replication, writeback
from tributary.plans import inputs
from tributary.plans.inputs import LOG_SQL, table
from tributary.session import shared_dir
from tributary.streaming import drain as draining
from tributary.streaming.sinks import UpsertSink
from tributary.tables import MergeTable


def cdc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = changes.decode(inputs.event_log(spark, sf_dir))
    return decoded.select(
        "change_id", "op", F.col("table").alias("table_name"), "id",
        F.col("before").isNotNull().alias("has_before"), F.col("after").isNotNull().alias("has_after"),
    )


def cdc_op_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.op_counts(changes.decode(inputs.event_log(spark, sf_dir)))


def cdc_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with views under an unknown code, cheap clicks without image and purchases with broken ones."""
    kind, value = F.col("event_type"), F.col("value")
    raw = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("change_id"),
        F.when(kind == "view", 7).when(kind == "error", -1).when(kind != "signup", 1).alias("change_type"),
        F.lit("docs").alias("table_name"),
        F.when(value >= 20, F.col("props")).alias("before"),
        F.when(kind == "purchase", F.expr("substring(props, 2)"))
        .when((kind != "click") | (value >= 20), F.col("props")).alias("after"),
    )
    return changes.skipped_by_reason(raw)


def cdc_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.fold(inputs.event_effects(spark, sf_dir).select("id", "change_id", "op"))


def cdc_upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.document_rows(changes.fold(inputs.event_effects(spark, sf_dir)))


def cdc_moved_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged table when views worth more than 40 move their row to the next key: the old row is left."""
    log = inputs.event_log(spark, sf_dir)
    moved = table(spark, sf_dir, "events").where("event_type = 'view' and value > 40").select(
        F.col("event_id").alias("change_id"), (F.col("user_id") + 1).cast("string").alias("_to")
    )
    image = F.when(F.col("_to").isNull(), F.col("after")).otherwise(
        F.concat(F.lit('{"id":"'), F.col("_to"), F.lit('",'), F.regexp_replace("after", '^\\{"id":"[^"]*",', ""))
    )
    log = log.join(moved, "change_id", "left").withColumn("after", image).drop("_to")
    return changes.document_rows(changes.fold(changes.effects(changes.decode(log))))


def cdc_deleted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = changes.fold(inputs.event_effects(spark, sf_dir).select("id", "change_id", "op"))
    return folded.filter(F.col("op") == "delete").select("id", "change_id")


def cdc_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.violations(changes.decode(inputs.event_log(spark, sf_dir)), width=1000)


def cdc_append_vs_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the append-only lake, of the merged table, and whether merging in two steps gives the same."""
    decoded = changes.decode(inputs.event_log(spark, sf_dir))
    middle = inputs.middle_change(spark, sf_dir)
    effects = changes.effects(decoded)
    stepwise = changes.upsert_into(replication.snapshot(effects, middle), replication.increment(effects, middle))
    check = changes.same_content(changes.live(changes.fold(effects)), changes.live(stepwise))
    appended = changes.lake_rows(decoded).agg(F.count(F.lit(1)).alias("n"))
    return check.select(
        appended.scalar().alias("append_rows"), F.col("left_rows").alias("merged_rows"), "consistent"
    )


def lake_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The append-only table: the text of every insert and update image."""
    rows = changes.lake_rows(changes.decode(inputs.event_log(spark, sf_dir)))
    return rows.select("change_id", "op", "id", F.get_json_object("image", "$.text").alias("text"))


def capture_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders captured by hand as shadow rows of one insert batch."""
    batch = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return changes.capture_inserts(batch, 1)


def cdc_typed_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with right and wrong JSON types: a number as text, text as a number, a fraction, an overflow."""
    image = F.to_json(
        F.struct(
            F.concat(F.lit("P"), "p_partkey").alias("patent_id"),
            F.col("p_name").alias("title"),
            F.col("p_size").alias("abstract"),
            F.when(F.col("p_size") > 25, F.col("p_brand")).alias("assignee"),
            F.col("p_type").alias("grant_date"),
            F.col("p_size").alias("grant_year"),
            F.col("p_retailprice").alias("claims_len"),
            F.col("p_size").cast("string").alias("n_cpc"),
            (F.col("p_partkey") * 10_000_000).alias("n_citations"),
        )
    )
    return changes.patent_rows(table(spark, sf_dir, "part").select(image.alias("image")))


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    effects = inputs.event_effects(spark, sf_dir)
    old = replication.snapshot(effects, inputs.middle_change(spark, sf_dir))
    return changes.document_rows(old), changes.document_rows(changes.fold(effects))


def _diff(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        old, new = _states(spark, sf_dir)
        return changes.capture_diff(old, new, "id", "docs", mode)

    return query


def replica_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = replication.snapshot(inputs.event_effects(spark, sf_dir), inputs.middle_change(spark, sf_dir))
    return changes.document_rows(old)


def replica_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    effects = inputs.event_effects(spark, sf_dir).select("id", "change_id", "op")
    return replication.increment(effects, inputs.middle_change(spark, sf_dir))


def replica_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    effects = inputs.event_effects(spark, sf_dir)
    middle = inputs.middle_change(spark, sf_dir)
    replica = replication.catch_up(replication.snapshot(effects, middle), replication.increment(effects, middle))
    return replication.convergence(changes.fold(effects), replica)


def prune_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = inputs.event_log(spark, sf_dir).select("change_id", "change_type")
    return changes.remaining(log, inputs.middle_change(spark, sf_dir))


def change_feed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.change_events(changes.decode(inputs.event_log(spark, sf_dir))).select("change_id", "value")


def _outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as outboxes: users queue plain text, the others queue JSON."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("src"),
        F.col("turn").alias("seq"),
        F.when(F.col("role") == "user", F.col("text"))
        .otherwise(F.to_json(F.struct("role", "text"))).alias("payload"),
        "role",
    )


def outbox_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    outbox = _outbox(spark, sf_dir)
    acks = outbox.filter(F.col("role") == "system").select("src", "seq")
    return writeback.message(writeback.pending(outbox, acks))


def outbox_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one flush acknowledges when every payload whose length is a multiple of 5 is refused."""
    outbox = _outbox(spark, sf_dir)
    acks = outbox.filter(F.col("role") == "system").select("src", "seq")
    page = writeback.next_page(writeback.pending(outbox, acks))
    return writeback.delivered_prefix(page, F.length("payload") % 5 != 0).select("src", "seq")


def inbox_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns share one message id, as a redelivery does; the later one stays."""
    turns = _outbox(spark, sf_dir)
    shared = scalars.writeback_id(F.col("src"), F.floor(F.col("seq") / 2))
    return writeback.landed(writeback.message(turns).withColumn("id", shared)).select("id", "src", "payload")


def stream_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upserted table after the log went through the streaming drain into a merge table."""
    folder = f"{shared_dir(spark)}/stream_drain/{uuid.uuid4().hex}"
    draining.append_changes(spark, inputs.event_log(spark, sf_dir), f"{folder}/log", 0)
    sink = UpsertSink(MergeTable(spark, f"{folder}/docs"))
    draining.drain(spark, f"{folder}/log", [sink], f"{folder}/checkpoint", table="docs")
    return sink.documents()


QUERIES = {
    f.__name__: f
    for f in (
        cdc_decode, cdc_op_counts, cdc_skipped, cdc_fold, cdc_upsert_snapshot, cdc_moved_keys, cdc_deleted_keys, cdc_violations,
        cdc_append_vs_merged, lake_append, capture_shadow, cdc_typed_image, replica_bootstrap, replica_delta, replica_converged, prune_log,
        change_feed_json, outbox_pending, outbox_prefix, inbox_upsert, stream_drain,
    )
} | {f"snapshot_diff_{mode}": _diff(mode) for mode in ("full", "after", "before", "id")}

_IMAGE = "json_object('id', {0}.id, 'text', {0}.text, 'meta', {0}.meta, 'ts', {0}.ts)::VARCHAR"


def _diff_sql(before: bool, after: bool) -> str:
    old = f"CASE WHEN o.id IS NOT NULL THEN {_IMAGE.format('o')} END" if before else "CAST(NULL AS VARCHAR)"
    new = f"CASE WHEN n.id IS NOT NULL THEN {_IMAGE.format('n')} END" if after else "CAST(NULL AS VARCHAR)"
    return f"""{LOG_SQL},
        o AS (SELECT id, text, meta, ts FROM last_old WHERE op <> 'delete'),
        n AS (SELECT id, text, meta, ts FROM last_all WHERE op <> 'delete')
        SELECT coalesce(n.id, o.id) AS id,
               CASE WHEN o.id IS NULL THEN 1 WHEN n.id IS NULL THEN -1 ELSE 0 END AS change_type,
               'docs' AS table_name, {old} AS before, {new} AS after
        FROM o FULL OUTER JOIN n ON o.id = n.id
        WHERE o.id IS NULL OR n.id IS NULL OR (o.text, o.meta, o.ts) IS DISTINCT FROM (n.text, n.meta, n.ts)"""


_OUTBOX_SQL = """
WITH outbox AS (
  SELECT CAST(conv_id AS VARCHAR) AS src, turn AS seq, role, text,
         CASE WHEN role = 'user' THEN text ELSE json_object('role', role, 'text', text)::VARCHAR END AS payload
  FROM conversations)
"""
_PAYLOAD = "CASE WHEN json_valid(payload) THEN payload ELSE to_json(payload)::VARCHAR END"

SQL = {
    "cdc_decode": f"""{LOG_SQL}
        SELECT change_id, op, 'docs' AS table_name, id, op <> 'insert' AS has_before, op <> 'delete' AS has_after
        FROM log""",
    "cdc_op_counts": f"{LOG_SQL} SELECT op, count(*) AS c FROM log GROUP BY 1",
    "cdc_skipped": """
        SELECT reason, count(*) AS c FROM (
          SELECT CASE WHEN event_type IN ('view', 'signup') THEN 'unknown change type'
                      WHEN event_type IN ('error', 'click') AND value < 20 THEN 'no row image'
                      WHEN event_type = 'purchase' THEN 'image is not JSON' END AS reason FROM events)
        WHERE reason IS NOT NULL GROUP BY 1""",
    "cdc_fold": f"{LOG_SQL} SELECT id, change_id, op FROM last_all",
    "cdc_upsert_snapshot": f"{LOG_SQL} SELECT id, text, meta, ts FROM last_all WHERE op <> 'delete'",
    "cdc_moved_keys": f"""{LOG_SQL},
        placed AS (
          SELECT change_id, op, text, meta, log.ts AS ts, CASE WHEN text = 'view' AND value > 40 THEN CAST(user_id + 1 AS VARCHAR) ELSE id END AS id
          FROM log JOIN events ON event_id = change_id),
        last AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY change_id DESC) AS rn FROM placed)
        SELECT id, text, meta, ts FROM last WHERE rn = 1 AND op <> 'delete'""",
    "cdc_deleted_keys": f"{LOG_SQL} SELECT id, change_id FROM last_all WHERE op = 'delete'",
    "cdc_violations": f"""{LOG_SQL}
        SELECT id, change_id, 'insert on a live key' AS reason FROM (
          SELECT *, lag(op) OVER (PARTITION BY id ORDER BY change_id) AS prev FROM log)
        WHERE op = 'insert' AND prev <> 'delete'""",
    "cdc_append_vs_merged": f"""{LOG_SQL}
        SELECT (SELECT count(*) FROM log WHERE op <> 'delete') AS append_rows,
               (SELECT count(*) FROM last_all WHERE op <> 'delete') AS merged_rows, TRUE AS consistent""",
    "lake_append": f"{LOG_SQL} SELECT change_id, op, id, text FROM log WHERE op <> 'delete'",
    "capture_shadow": """
        SELECT CAST(1 AS BIGINT) AS version, 'INSERT' AS change_type, o_orderkey, o_custkey, o_orderstatus FROM orders""",
    "cdc_typed_image": """
        SELECT 'P' || p_partkey AS patent_id, p_name AS title, CAST(NULL AS VARCHAR) AS abstract,
               CASE WHEN p_size > 25 THEN p_brand END AS assignee, p_type AS grant_date,
               p_size AS grant_year, CAST(NULL AS INTEGER) AS claims_len, CAST(NULL AS INTEGER) AS n_cpc,
               TRY_CAST(p_partkey * 10000000 AS INTEGER) AS n_citations FROM part""",
    "replica_bootstrap": f"{LOG_SQL} SELECT id, text, meta, ts FROM last_old WHERE op <> 'delete'",
    "replica_delta": f"{LOG_SQL} SELECT id, change_id, op FROM last_new",
    "replica_converged": f"""{LOG_SQL}
        SELECT count(*) AS master_rows, count(*) AS replica_rows, TRUE AS converged
        FROM last_all WHERE op <> 'delete'""",
    "prune_log": """
        SELECT event_id AS change_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS change_type
        FROM events WHERE event_id > (SELECT floor((min(event_id) + max(event_id)) / 2) FROM events)""",
    "change_feed_json": f"""{LOG_SQL}
        SELECT change_id, '{{"op":"' || op || '","table":"docs","id":"' || id || '","after":'
               || CASE WHEN op <> 'delete' THEN img ELSE 'null' END || ',"before":'
               || CASE WHEN op <> 'insert' THEN img ELSE 'null' END || '}}' AS value
        FROM (SELECT *, json_object('id', id, 'meta', meta, 'text', text, 'ts', ts)::VARCHAR AS img FROM log)""",
    "outbox_pending": f"""{_OUTBOX_SQL}
        SELECT src || '-' || seq AS id, src, seq, {_PAYLOAD} AS payload FROM outbox WHERE role <> 'system'""",
    "outbox_prefix": f"""{_OUTBOX_SQL},
        page AS (
          SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY seq) AS rn FROM outbox
                         WHERE role <> 'system') WHERE rn <= 1000),
        failed AS (SELECT src, min(seq) AS at FROM page WHERE length(payload) % 5 = 0 GROUP BY src)
        SELECT p.src, p.seq FROM page p LEFT JOIN failed f ON f.src = p.src WHERE f.at IS NULL OR p.seq < f.at""",
    "inbox_upsert": f"""{_OUTBOX_SQL}
        SELECT id, src, payload FROM (
          SELECT src || '-' || (seq // 2) AS id, src, {_PAYLOAD} AS payload,
                 row_number() OVER (PARTITION BY src, seq // 2 ORDER BY seq DESC) AS rn FROM outbox) WHERE rn = 1""",
    "snapshot_diff_full": _diff_sql(True, True),
    "snapshot_diff_after": _diff_sql(False, True),
    "snapshot_diff_before": _diff_sql(True, False),
    "snapshot_diff_id": _diff_sql(False, False),
}
SQL["stream_drain"] = SQL["cdc_upsert_snapshot"]
