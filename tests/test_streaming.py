import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import change_log, doc, lines, tuples
from tributary import tables
from tributary.operators import changes, stats
from tributary.sources import feeds
from tributary.streaming import drain as draining
from tributary.streaming import sinks

I, U, D = 1, 0, -1


def effects(spark, *rows):
    return changes.document_state(changes.effects(changes.decode(change_log(spark, *rows))))


def ids(df):
    return sorted(r.id for r in df.collect())


class Flow:
    """A log, its sinks and their checkpoint in one folder."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.version = spark, folder, 0
        self.upsert = sinks.UpsertSink(tables.MergeTable(spark, f"{folder}/docs"))
        self.lake = sinks.LakeSink(spark, f"{folder}/lake")
        self.feed = sinks.JsonlSink(spark, f"{folder}/feed")

    def log(self, *rows, table="docs"):
        draining.append_changes(self.spark, change_log(self.spark, *rows, table=table), f"{self.folder}/log", self.version)
        self.version += 1

    def drain(self, *more, **options):
        return draining.drain(
            self.spark, f"{self.folder}/log", more or [self.upsert, self.lake, self.feed], f"{self.folder}/cp", "docs", **options
        )


def test_two_drains_with_pruning_keep_everything(spark, folder):
    flow = Flow(spark, folder)
    flow.log((1, I, None, doc("a", "one")), (2, I, None, doc("x")), (3, D, doc("x"), None), (4, 7, None, doc("y")))
    flow.log((1, I, None, doc("other")), table="other")
    first = flow.drain()
    assert (first.changes, first.skipped, first.by_op) == (3, 1, {"insert": 2, "update": 0, "delete": 1})
    assert draining.prune(spark, f"{folder}/log", [0]) == 1
    flow.log((5, I, None, doc("b", "two", ts=9)))
    second = flow.drain()
    assert second.changes == 1 and second.changes_per_second > 0
    assert tuples(flow.upsert.documents()) == [("a", "one", "", 0), ("b", "two", "", 9)]
    assert ids(flow.lake.rows()) == ["a", "b", "x"]
    events = [json.loads(r.value) for r in flow.feed.lines().collect()]
    assert sorted((e["op"], e["id"]) for e in events) == [("delete", "x"), ("insert", "a"), ("insert", "b"), ("insert", "x")]
    assert flow.drain().changes == 0


def test_a_drain_needs_a_sink(spark, folder):
    with pytest.raises(draining.NoSink):
        draining.drain(spark, folder, [], f"{folder}/cp")


def test_a_failed_drain_is_resumed_without_loss_or_repeats(spark, folder):
    flow = Flow(spark, folder)
    flow.log((1, I, None, doc("a")), (2, I, None, doc("b")))

    class Broken:
        def apply(self, decoded, version):
            raise RuntimeError("sink is down")

    with pytest.raises(Exception, match="sink is down"):
        flow.drain(flow.upsert, flow.lake, Broken())
    assert flow.drain().changes == 2
    assert ids(flow.lake.rows()) == ["a", "b"] and ids(flow.upsert.documents()) == ["a", "b"]


def test_strict_sink_refuses_a_second_insert(spark, folder):
    flow = Flow(spark, folder)
    strict = sinks.StrictSink(flow.upsert.table)
    flow.log((1, I, None, doc("a")))
    flow.drain(strict)
    flow.log((2, I, None, doc("a", "again")))
    with pytest.raises(Exception, match="insert on a live key 'a'"):
        flow.drain(strict)
    assert tuples(flow.upsert.documents()) == [("a", "t", "", 0)]


def test_strict_decoding_fails_the_drain(spark, folder):
    flow = Flow(spark, folder)
    flow.log((1, I, None, "{oops"))
    with pytest.raises(Exception, match="image is not JSON"):
        flow.drain(strict=True)


def test_delivery_keeps_the_order_of_each_key(spark, folder):
    flow = Flow(spark, folder)
    flow.log(*[(i, I if i < 2 else U, doc("ab"[i % 2]), doc("ab"[i % 2], f"t{i}")) for i in range(20)])
    out = f"{folder}/delivered"

    def deliver(event):
        event = json.loads(event)
        with open(f"{out}-{event['id']}", "a") as f:
            f.write(event["after"]["text"] + "\n")

    sink = sinks.DeliverSink(deliver)
    flow.drain(sink)
    assert sink.sent == 20
    for start, key in enumerate("ab"):
        with open(f"{out}-{key}") as f:
            assert f.read().split() == [f"t{i}" for i in range(start, 20, 2)]
    counted = sinks.DeliverSink(lambda event: None, ordered=False)
    counted.apply(changes.decode(change_log(spark, (1, I, None, doc("a")))), 0)
    assert counted.sent == 1


def test_delivery_failure_fails_the_drain(spark, folder):
    flow = Flow(spark, folder)
    flow.log((1, I, None, doc("a")))

    def refuse(event):
        raise IOError("status 500")

    with pytest.raises(Exception, match="status 500"):
        flow.drain(sinks.DeliverSink(refuse))


def test_shadow_rows(spark, folder):
    sink = sinks.ShadowSink(spark, folder)
    batch = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    sink.apply(batch, 0)
    sink.apply(batch, 0)
    sink.apply(batch.limit(1), 1)
    assert sorted((r.version, r.id, r.change_type) for r in sink.rows().collect()) == [(0, "a", "INSERT"), (0, "b", "INSERT"), (1, "a", "INSERT")]


def test_merge_table_versions(spark, folder):
    table = tables.MergeTable(spark, folder)
    assert table.version() == -1 and table.rows().count() == 0
    assert table.apply(effects(spark, (1, I, None, doc("a")), (2, I, None, doc("b"))), 0)
    assert not table.apply(effects(spark, (9, I, None, doc("z"))), 0)
    table.apply(effects(spark, (3, D, doc("a"), None), (4, I, None, doc("c"))), 1)
    assert ids(table.rows()) == ["b", "c"] and ids(table.rows(0)) == ["a", "b"]
    assert table.compact() == 1 and table.compact() == 1
    table.apply(effects(spark, (5, U, doc("b"), doc("b", "new"))), 2)
    assert ids(table.rows()) == ["b", "c"] and ids(table.rows(1)) == ["b", "c"] and ids(table.rows(0)) == ["a", "b"]
    assert ids(table.deltas.read(1, 2)) == ["b"]
    assert table.expire() == 2 and table.expire() == 0
    assert ids(table.rows()) == ["b", "c"]


def test_late_changes_lose_against_rows_and_tombstones(spark, folder):
    table = tables.MergeTable(spark, folder)
    table.apply(effects(spark, (10, I, None, doc("a", "new")), (11, D, doc("b"), None)), 0)
    table.compact()
    table.apply(effects(spark, (5, I, None, doc("a", "old")), (6, I, None, doc("b", "old"))), 1)
    assert [(r.id, r.text) for r in table.rows().collect()] == [("a", "new")]
    table.compact(forget_below=12)
    assert ids(table.state()) == ["a"]


def _half_written(spark, versions, rows, version):
    """What a write leaves behind that died before its commit."""
    versions._overwrite(rows, version)


def test_an_unfinished_write_is_invisible(spark, folder):
    table = tables.MergeTable(spark, folder)
    table.apply(effects(spark, (1, I, None, doc("a"))), 0)
    _half_written(spark, table.deltas, effects(spark, (2, I, None, doc("b"))), 1)
    assert table.version() == 0 and ids(table.rows()) == ["a"]
    assert table.apply(effects(spark, (2, I, None, doc("c"))), 1)
    assert ids(table.rows()) == ["a", "c"]


def test_a_drain_reads_committed_versions_only(spark, folder):
    flow = Flow(spark, folder)
    flow.log((1, I, None, doc("a")))
    _half_written(spark, draining.change_versions(spark, f"{folder}/log"), change_log(spark, (2, I, None, doc("b"))), 1)
    assert flow.drain().changes == 1
    flow.log((2, I, None, doc("b")))
    assert flow.drain().changes == 1
    assert ids(flow.lake.rows()) == ids(flow.upsert.documents()) == ["a", "b"]
    assert flow.feed.lines().count() == 2


def test_only_touched_buckets_are_folded(spark, folder):
    table = tables.MergeTable(spark, folder)
    table.apply(effects(spark, *[(i, I, None, doc(f"k{i}")) for i in range(300)]), 0)
    table.compact()
    table.expire()
    assert "Exchange" not in table.rows()._jdf.queryExecution().executedPlan().toString()
    table.apply(effects(spark, (999, U, doc("k1"), doc("k1", "new")), (1000, I, None, doc("z"))), 1)
    touched = table.deltas.touched(0, 1)
    assert len(touched) in (1, 2)
    rows = {r.id: r.text for r in table.rows().collect()}
    assert len(rows) == 301 and rows["k1"] == "new" and rows["k2"] == "t"
    asked = spark.createDataFrame([("k1",)], "id string")
    found = table.touching(asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and plan.count("bucket#") > 0
    files = {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles() if "bucket=" in f}
    assert [(r.id, r.text) for r in found.collect()] == [("k1", "new")] and files


def test_replicas_follow(spark, folder):
    master, replica = tables.MergeTable(spark, f"{folder}/m"), tables.MergeTable(spark, f"{folder}/r")
    assert not tables.pull(master, replica)
    master.apply(effects(spark, (1, I, None, doc("a")), (2, I, None, doc("b"))), 0)
    assert tables.bootstrap(master, replica) == 0 and ids(replica.rows()) == ["a", "b"]
    assert not tables.pull(master, replica)
    master.apply(effects(spark, (3, D, doc("a"), None)), 1)
    master.apply(effects(spark, (4, I, None, doc("c"))), 2)
    assert tables.pull(master, replica) and ids(replica.rows()) == ["b", "c"]
    master.apply(effects(spark, (5, I, None, doc("d"))), 3)
    master.compact()
    master.expire()
    assert tables.pull(master, replica) and ids(replica.rows()) == ["b", "c", "d"]
    master.apply(effects(spark, (6, D, doc("d"), None)), 4)
    master.compact(forget_below=100)
    assert tables.pull(master, replica) and ids(replica.rows()) == ["b", "c"]  # the deletion is forgotten, not lost
    assert changes.same_content(master.rows(), replica.rows()).first()["consistent"]


def test_feed_lands_as_a_stream(spark, folder):
    event = {"type": "edit", "wiki": "w", "namespace": 0, "title": "T", "comment": "c", "meta": {"id": "e1"}}
    for n, text in enumerate(["data: " + json.dumps(event), "data: {oops", "data: " + json.dumps(event | {"meta": {"id": "e2"}})]):
        lines(spark, text).coalesce(1).write.text(f"{folder}/landing/{n}")
    seen = []
    stream = spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).text(f"{folder}/landing")
    query = draining.land_documents(
        stream, lambda df: feeds.edit_documents(df, "w", "0"), lambda batch, v: seen.append((v, ids(batch))), f"{folder}/cp"
    )
    query.awaitTermination()
    assert [v for v, _ in seen] == [0, 1, 2] and sorted(i for _, b in seen for i in b) == ["e1", "e2"]


def test_event_rate_as_a_stream(spark, folder):
    events = spark.sql(
        "SELECT timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 20) AS ts FROM range(10) "
        "UNION ALL SELECT timestamp_ntz'2024-01-02'"
    )
    events.write.parquet(f"{folder}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/events")
    query = (
        stats.rate_per_window(stream, late="1 minute")
        .writeStream.outputMode("append").format("memory").queryName("rate")
        .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = sorted((r.window_start.minute, r.n) for r in spark.table("rate").collect())
    assert got == [(0, 3), (1, 3), (2, 3), (3, 1)]  # the last window is still open behind the watermark
    batch = stats.rate_per_window(events).filter(F.col("window_start") < "2024-01-02")
    assert sorted((r.window_start.minute, r.n) for r in batch.collect()) == got
