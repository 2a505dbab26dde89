"""Data on the move: repair, merges by bucket, folds and rates in streams, quarantine, delivery, the partitioned log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary import schemas
from tributary.engine import Engine
from tributary.functions import vectors
from tributary.operators import changes, embedding, repair, replication, stats, upsert
from tributary.plans import inputs
from tributary.plans.ingest import firehose_lines
from tributary.plans.inputs import LOG_SQL, embed_sql, table
from tributary.session import shared_dir, written_once
from tributary.sources import changelog, feeds
from tributary.streaming import delivery, runs
from tributary.streaming import fold as folding

ROWS_PER_LANDED_FILE = 2_000_000  # a micro-batch is of some files and has a fixed cost a task of its state
DOCUMENT_STATE = schemas.struct("id string, change_id bigint, op string, text string, meta string, ts bigint")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}/{uuid.uuid4().hex}"


def replica_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a replica has to take over that missed the last twentieth of the log."""
    effects = inputs.event_effects(spark, sf_dir)
    ids = table(spark, sf_dir, "events")
    cut = ids.agg(F.floor(F.max("event_id") - (F.max("event_id") - F.min("event_id")) / 20).alias("cut")).scalar()
    master = written_once(changes.document_rows(changes.fold(effects)))
    replica = written_once(changes.document_rows(replication.snapshot(effects, cut)))
    return repair.repair(master, replica).sent


def upsert_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged table after three batches, the first of them merged again at last."""
    state = changes.document_state(inputs.event_effects(spark, sf_dir))
    state = written_once(state.withColumn("part", F.pmod(F.xxhash64("change_id"), F.lit(3))))
    merged = upsert.BucketTable(spark, _folder(spark, "upsert"), DOCUMENT_STATE)
    for part in (0, 1, 2, 0):
        merged.merge(state.where(F.col("part") == part))
    return merged.rows().drop("change_id", "op")


def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of a log whose changes arrive out of order, one in ten twice, in a stream that is stopped and restarted."""
    folder = _folder(spark, "stream_fold")
    effects = inputs.event_effects(spark, sf_dir).select("id", "change_id", "op")
    arrival = F.pmod(F.xxhash64("change_id"), F.lit(4))
    twice = F.when(F.col("change_id") % 10 == 0, F.array(arrival, F.pmod(arrival + 2, F.lit(4)))).otherwise(F.array(arrival))
    arriving = written_once(effects.select("*", F.explode(twice).alias("slot")))
    rows = {r["slot"]: r["count"] for r in arriving.groupBy("slot").count().collect()}
    for slots in ((0, 1), (2, 3)):
        for slot in slots:
            files = max(2, -(-rows.get(slot, 0) // ROWS_PER_LANDED_FILE))
            arriving.where(F.col("slot") == slot).drop("slot").repartition(files).write.mode("append").parquet(f"{folder}/arrived")
        stream = spark.readStream.schema("id string, change_id bigint, op string").option("maxFilesPerTrigger", 2).parquet(f"{folder}/arrived")
        runs.run_into(folding.newest_changes(stream), f"{folder}/folded", f"{folder}/checkpoint")
    return folding.folded(spark.read.schema("id string, change_id bigint, op string").parquet(f"{folder}/folded"))


def feed_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an edit feed kept and refused by reason, as written and as counted while they were written."""
    path = _folder(spark, "feed_quarantine")
    counted = feeds.land_examined(feeds.examined_edits(firehose_lines(spark, sf_dir), "enwiki", "0"), path)
    seen = spark.createDataFrame([(r, n) for r, n in counted.items() if n], "reason string, observed bigint")
    found = spark.read.parquet(path).groupBy(F.coalesce("reason", F.lit("")).alias("reason")).agg(
        F.count(F.lit(1)).alias("lines"), F.count("id").alias("documents"), F.count("value").alias("kept_lines")
    )
    return found.join(seen, "reason", "left")


def feed_to_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed lines of an edit feed streamed into documents and their vectors, which one version holds together."""
    folder = _folder(spark, "feed_to_docs")
    lines = firehose_lines(spark, sf_dir, unnamed="")
    lines.write.text(f"{folder}/landed")
    engine = Engine(spark, f"{folder}/engine", embedding.hash_model(inputs.DIM), f"hash-{inputs.DIM}")
    stream = spark.readStream.text(f"{folder}/landed")
    engine.land(stream, lambda landed: feeds.edit_documents(landed, "enwiki", "0"), "edits").awaitTermination()
    return engine.table.rows().select(
        "id", "text", F.get_json_object("meta", "$.url").alias("url"), vectors.vector_to_json(F.col("emb"), 6).alias("emb")
    )


def delivered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each key up to the first that its receiver refused, and all of them after it was asked again."""
    path = _folder(spark, "delivered_events")
    log = inputs.event_log(spark, sf_dir)
    events = written_once(changes.change_events(changes.decode(log)).select(F.col("id").alias("key"), F.col("change_id").alias("seq"), "value"))

    def refusing(key: object, seq: int, value: str) -> bool:
        return '"op":"delete"' not in value

    def taking(key: object, seq: int, value: str) -> bool:
        return True

    width = 4000
    delivery.Delivery(spark, path, refusing, width).run(events)
    schema = "key string, seq bigint, sent bigint, refused boolean"
    first = written_once(delivery.Delivery(spark, path, refusing, width).acknowledged(schema)).select("key", F.col("seq").alias("first_upto"), F.col("sent").alias("first_sent"))
    second = delivery.Delivery(spark, path, taking, width)
    second.run(events)
    return second.acknowledged(schema).select("key", F.col("seq").alias("upto"), "sent").join(first, "key", "left")


def log_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of one table of a log of several past an id."""
    path = _folder(spark, "log_after")
    log = inputs.event_log(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("change_id"), "event_type"), "change_id")
    own = F.when(F.col("event_type") == "purchase", "orders").when(F.col("event_type") == "click", "clicks").otherwise(F.col("table_name"))
    changelog.write_changes(log.withColumn("table_name", own).drop("event_type"), path, width=10_000)
    middle = table(spark, sf_dir, "events").agg(F.floor((F.min("event_id") + F.max("event_id")) / 2)).first()[0] or 0
    return changelog.read_changes(spark, path, "docs", middle).select("change_id", "change_type", "table_name", F.col("after").isNotNull().alias("has_after"))


def event_rate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of a stream of three arrivals; one event in twenty arrives last, mostly behind the watermark."""
    folder = _folder(spark, "event_rate_stream")
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    middle = inputs.middle_change(spark, sf_dir)
    slot = F.when(F.col("event_id") % 20 == 7, 2).when(F.col("event_id") <= middle, 0).otherwise(1)
    arriving = written_once(events.withColumn("slot", slot))
    for arrival in range(3):
        arriving.where(F.col("slot") == arrival).drop("slot").write.mode("append").parquet(f"{folder}/arrived")
        stream = spark.readStream.schema("event_id bigint, ts timestamp").parquet(f"{folder}/arrived")
        counted = stats.rate_per_window(stream, "ts", "1 hour", late="2 hours")
        runs.run_into(counted, f"{folder}/closed", f"{folder}/checkpoint")
    closed = spark.read.schema(counted.schema).parquet(f"{folder}/closed")
    return closed.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


def latency_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles from merged sketches of the versions, and whether their ranks are within the sketch's error."""
    path = _folder(spark, "latency_sketch")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    day = F.floor(F.col("event_id") / 1000)
    stats.add_sketches(events.withColumn("version", day), path, "version", "event_type", "value")
    merged = stats.merged_sketches(spark.read.parquet(path), "event_type")
    return stats.within_bounds(merged, events, "event_type", "value", (0.5, 0.95))


QUERIES = {
    f.__name__: f
    for f in (
        replica_repair, upsert_batches, stream_fold, feed_quarantine, feed_to_docs, delivered_events, log_after, event_rate_stream, latency_sketch,
    )
}

_EVENTS = """
SELECT doc_id, source, text, lang,
       CASE WHEN source = 'src4' THEN 'no payload' WHEN source = 'src3' THEN 'not JSON'
            WHEN lang = 'de' THEN 'other type' WHEN source IN ('src2', '') THEN 'no title'
            WHEN lang = 'es' THEN 'other namespace' ELSE '' END AS reason FROM documents"""
_FED = f"""(SELECT 'e' || doc_id AS id, source || ': ' || text AS text, CASE WHEN source = 'src1' THEN '' ELSE 'http://' || source END AS url
            FROM ({_EVENTS}) WHERE reason = '')"""

SQL = {
    "replica_repair": f"""{LOG_SQL},
        cut AS (SELECT CAST(floor(max(event_id) - (max(event_id) - min(event_id)) / 20) AS BIGINT) AS c FROM events),
        old AS (
          SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY change_id DESC) AS rn FROM log WHERE change_id <= (SELECT c FROM cut))
          WHERE rn = 1 AND op <> 'delete'),
        new AS (SELECT * FROM last_all WHERE op <> 'delete')
        SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN 'delete' ELSE 'upsert' END AS op, n.text, n.meta, n.ts
        FROM new n FULL OUTER JOIN old o ON n.id = o.id
        WHERE n.id IS NULL OR o.id IS NULL OR (n.text, n.meta, n.ts) IS DISTINCT FROM (o.text, o.meta, o.ts)""",
    "upsert_batches": f"{LOG_SQL} SELECT id, text, meta, ts FROM last_all WHERE op <> 'delete'",
    "stream_fold": f"{LOG_SQL} SELECT id, change_id, op FROM last_all",
    "feed_quarantine": f"""
        SELECT reason, count(*) AS lines, count(*) FILTER (reason = '') AS documents, count(*) FILTER (reason <> '') AS kept_lines, count(*) AS observed
        FROM ({_EVENTS}) GROUP BY reason""",
    "feed_to_docs": f"""WITH fed AS (SELECT * FROM {_FED}),
        {embed_sql("fv", "fed", "id")}
        SELECT fed.id, text, url, '[' || list_aggregate(list_transform(emb, lambda x: printf('%.6f', x::DOUBLE)), 'string_agg', ',') || ']' AS emb
        FROM fed JOIN fv ON fv.id = fed.id""",
    "delivered_events": f"""{LOG_SQL},
        stop AS (SELECT id, min(change_id) AS refused FROM log WHERE op = 'delete' GROUP BY id),
        taken AS (SELECT id, max(change_id) AS upto, count(*) AS n FROM log LEFT JOIN stop USING (id) WHERE refused IS NULL OR change_id < refused GROUP BY id)
        SELECT log.id AS key, max(log.change_id) AS upto, count(*) AS sent, any_value(taken.upto) AS first_upto, coalesce(any_value(taken.n), 0) AS first_sent
        FROM log LEFT JOIN taken ON taken.id = log.id GROUP BY log.id""",
    "log_after": """
        SELECT event_id AS change_id, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS change_type,
               'docs' AS table_name, event_type <> 'error' AS has_after
        FROM events WHERE event_type NOT IN ('purchase', 'click') AND event_id > (SELECT floor((min(event_id) + max(event_id)) / 2) FROM events)""",
    "event_rate_stream": """
        WITH a AS (
          SELECT ts, date_trunc('hour', ts) AS w,
                 CASE WHEN event_id % 20 = 7 THEN 2 WHEN event_id <= (SELECT floor((min(event_id) + max(event_id)) / 2) FROM events) THEN 0 ELSE 1 END AS slot
          FROM events),
        m AS (SELECT slot, max(ts) AS newest FROM a GROUP BY slot),
        b AS (SELECT s.slot, max(m.newest) - INTERVAL 2 HOUR AS mark FROM m s LEFT JOIN m ON m.slot < s.slot GROUP BY s.slot)
        SELECT w AS window_start, count(*) AS n FROM a JOIN b USING (slot)
        WHERE (mark IS NULL OR w + INTERVAL 1 HOUR > mark) AND w + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)
        GROUP BY w""",
    "latency_sketch": """
        SELECT event_type, share, count(value) AS n, TRUE AS within FROM events CROSS JOIN (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) s(share)
        GROUP BY event_type, share""",
}
