"""Repair, bucket merges, stream folds, quarantine, delivery, the partitioned log and sketches."""

import random

import pytest
from pyspark.sql import functions as F

from tributary import schemas
from tributary.operators import changes, repair, stats, upsert
from tributary.sources import changelog, feeds
from tributary.streaming import delivery, runs
from tributary.streaming import fold as folding

ROWS = "id string, change_id bigint, op string, text string"


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- repair ----------------------------------------------------------------------------------------


def test_repair_sends_what_differs_and_reads_differing_buckets_only(spark):
    rows = [(f"k{i}", f"text {i}", None if i % 9 == 0 else i) for i in range(3000)]
    master = spark.createDataFrame(rows, "id string, text string, n bigint")
    wrong = [(i, t, n) for i, t, n in rows if i != "k5"]
    wrong = [(i, "old" if i == "k7" else t, 0 if i == "k9" else n) for i, t, n in wrong] + [("gone", "x", 1)]
    replica = spark.createDataFrame(wrong, "id string, text string, n bigint").repartition(5)
    found = repair.repair(master, replica, buckets=512)
    assert tuples(found.sent) == sorted(
        [("k5", "upsert", 5, "text 5"), ("k7", "upsert", 7, "text 7"), ("k9", "upsert", None, "text 9"), ("gone", "delete", None, None)], key=repr
    )
    read = found.compared.first()
    assert read["ours"] + read["theirs"] < 100
    assert tuples(repair.repaired(replica, found.sent).select("id", "text", "n")) == sorted(rows, key=repr)
    assert repair.differing(master, repair.repaired(replica, found.sent)).isEmpty()


def test_repair_of_empty_sides(spark):
    full = spark.createDataFrame([("a", "x"), ("b", None)], "id string, text string")
    none = full.limit(0)
    assert tuples(repair.repair(full, none).sent) == [("a", "upsert", "x"), ("b", "upsert", None)]
    assert tuples(repair.repair(none, full).sent) == [("a", "delete", None), ("b", "delete", None)]
    assert repair.repair(none, none).sent.isEmpty() and repair.repair(full, full).sent.isEmpty()


def test_nulls_in_swapped_columns_differ(spark):
    a = spark.createDataFrame([("k", "x", None)], "id string, p string, q string")
    b = spark.createDataFrame([("k", None, "x")], "id string, p string, q string")
    assert tuples(repair.repair(a, b).sent) == [("k", "upsert", "x", None)]


# ---- bucket merges ---------------------------------------------------------------------------------


def _changes(seed, n, keys):
    rng = random.Random(seed)
    return [(f"k{0 if rng.random() < 0.3 else rng.randint(0, keys)}", i, rng.choice(["insert", "update", "delete"]), f"t{i}") for i in range(n)]


def test_merges_equal_the_fold_whatever_their_order(spark, folder):
    rows = _changes(1, 600, 80)
    df = spark.createDataFrame(rows, ROWS)
    table = upsert.BucketTable(spark, f"{folder}/t", schemas.struct("id string, change_id bigint, op string, text string"), buckets=8, files=2)
    assert table.rows().isEmpty()
    for low, high in ((300, 450), (0, 300), (450, 600), (0, 300)):
        table.merge(df.where((F.col("change_id") >= low) & (F.col("change_id") < high)))
    table.merge(df.limit(0))
    assert tuples(table.rows()) == tuples(changes.live(changes.fold(df)))
    assert table.state().where("op = 'delete'").count() > 0


def test_a_merge_reads_and_writes_touched_buckets_only(spark, folder):
    import glob
    import os

    df = spark.createDataFrame([(f"k{i}", i, "insert", "x") for i in range(200)], ROWS)
    table = upsert.BucketTable(spark, f"{folder}/t", schemas.struct("id string, change_id bigint, op string, text string"), buckets=16)
    table.merge(df)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{folder}/t/_bucket=*/*.parquet")}
    one = spark.createDataFrame([("k7", 900, "update", "new")], ROWS)
    [bucket] = table.touched(one)
    table.merge(one)
    after = {f for f in glob.glob(f"{folder}/t/_bucket=*/*.parquet")}
    assert {f for f in before if f not in after} == {f for f in before if f"_bucket={bucket}/" in f}
    assert table.rows().where("id = 'k7'").first()["text"] == "new" and table.rows().count() == 200
    plan = table.state().where(F.col("_bucket").isin([bucket]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [(_bucket" in plan


# ---- the fold of a stream --------------------------------------------------------------------------


def test_late_and_repeated_changes_in_a_restarted_stream(spark, folder):
    rows = _changes(2, 500, 40)
    rng = random.Random(3)
    arriving = rows + rng.sample(rows, 100)
    rng.shuffle(arriving)
    stream = None
    for part in range(4):
        spark.createDataFrame(arriving[part * 150 : part * 150 + 150], ROWS).write.mode("append").parquet(f"{folder}/arrived")
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 3).parquet(f"{folder}/arrived")
        runs.run_into(folding.newest_changes(stream), f"{folder}/folded", f"{folder}/checkpoint")
    written = spark.read.schema(ROWS).parquet(f"{folder}/folded")
    assert tuples(folding.folded(written)) == tuples(changes.fold(spark.createDataFrame(rows, ROWS)))
    per_key = {}
    assert written.count() < len(arriving)
    for r in written.collect():
        per_key.setdefault(r["id"], []).append(r["change_id"])
    assert all(len(set(v)) == len(v) for v in per_key.values())  # nothing comes out twice


def test_forgotten_keys_count_as_new(spark, folder):
    import time

    for change in (("a", 5), ("b", 6), ("a", 3), ("b", 2)):
        spark.createDataFrame([(*change, "update", "x")], ROWS).write.mode("append").parquet(f"{folder}/arrived")
        stream = spark.readStream.schema(ROWS).parquet(f"{folder}/arrived")
        runs.run_into(folding.newest_changes(stream, remember_ms=1), f"{folder}/folded", f"{folder}/checkpoint", idle_batches=False)
        time.sleep(0.05)
    found = sorted(r["change_id"] for r in spark.read.schema(ROWS).parquet(f"{folder}/folded").collect())
    assert found == [2, 3, 5, 6]  # each key was forgotten in the batch between


def test_the_state_of_a_fold_is_by_buckets_of_keys(spark, folder):
    rows = [(f"k{i % 6000}", i, "delete" if i % 7 == 0 else "update", f"t{i}") for i in range(12_000)] + [(None, 3, "update", "x"), (None, 9, "delete", "y")]
    for part in (rows[9000:], rows[:9000], rows):  # late ones second, all again at last
        spark.createDataFrame(part, ROWS).write.mode("append").parquet(f"{folder}/arrived")
        stream = spark.readStream.schema(ROWS).parquet(f"{folder}/arrived")
        runs.run_into(folding.newest_changes(stream), f"{folder}/folded", f"{folder}/checkpoint")
    written = spark.read.schema(ROWS).parquet(f"{folder}/folded")
    assert tuples(folding.folded(written)) == tuples(changes.fold(spark.createDataFrame(rows, ROWS)))
    assert written.count() == written.distinct().count() == 3001 + 3000  # newest first, then keys not seen yet, then nothing
    state = spark.read.format("statestore").load(f"{folder}/checkpoint")
    assert state.count() <= folding.BUCKETS and state.selectExpr("sum(size(value.groupState.keys)) as n").first()["n"] == 6001


# ---- quarantine ------------------------------------------------------------------------------------


def test_lines_are_kept_or_refused_for_a_reason(spark, folder):
    lines = [
        'data: {"type":"edit","wiki":"w","namespace":0,"title":"T","comment":"c","meta":{"id":"e1"}}',
        'data: {"type":"new","wiki":"w","namespace":0,"title":"U"}',
        "event: message", "", None, "data: {broken", 'data: {"type":"log","wiki":"w","namespace":0,"title":"T"}',
        'data: {"type":"edit","wiki":"w","namespace":0}', 'data: {"type":"edit","wiki":"v","namespace":0,"title":"T"}',
        'data: {"type":"edit","wiki":"w","namespace":1,"title":"T"}', 'data: {"type":"edit","wiki":"w","namespace":"0","title":"T"}',
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    examined = feeds.examined_edits(df, "w", "0")
    assert tuples(examined.where("reason is null").select("id", "text", "meta")) == tuples(feeds.edit_documents(df, "w", "0"))
    counted = feeds.land_examined(examined, f"{folder}/q")
    assert counted == {"": 2, "no payload": 3, "not JSON": 1, "other type": 1, "no title": 1, "other wiki": 1, "other namespace": 2}
    stored = spark.read.parquet(f"{folder}/q")
    assert {r["reason"]: r["count"] for r in stored.groupBy(F.coalesce("reason", F.lit("")).alias("reason")).count().collect()} == counted
    kept = stored.where("not refused").select("id", "text")
    assert "PartitionFilters: [isnotnull(refused" in kept._jdf.queryExecution().toString()
    assert sorted(r["value"] for r in stored.where("reason = 'not JSON'").collect()) == ["data: {broken"]


# ---- delivery --------------------------------------------------------------------------------------

ACKS = "key string, seq bigint, sent bigint, refused boolean"


def _taker(path, refuse=(), fail=()):
    """Writes what it takes to a file per key; refuses or fails on some numbers."""

    def send(key, seq, value):
        if seq in refuse:
            return False
        if seq in fail:
            raise OSError("receiver is away")
        with open(f"{path}/{key}", "a") as out:
            out.write(f"{seq}\n")
        return True

    return send


def test_a_key_waits_behind_a_refused_event_and_goes_on_later(spark, folder, tmp_path):
    got = tmp_path / "got"
    got.mkdir()
    events = spark.createDataFrame([("hot", i, "v") for i in range(1, 500)] + [("a", 601, "v"), ("a", 700, "v"), ("b", 650, "v")], "key string, seq bigint, value string").repartition(6)
    delivery.Delivery(spark, f"{folder}/d", _taker(got, refuse={250}, fail={601}), width=100).run(events)
    first = {r["key"]: (r["seq"], r["sent"]) for r in delivery.Delivery(spark, f"{folder}/d", None).acknowledged(ACKS).collect()}
    assert first == {"hot": (249, 249), "a": (None, 0), "b": (650, 1)}
    delivery.Delivery(spark, f"{folder}/d", _taker(got), width=100).run(events)
    delivery.Delivery(spark, f"{folder}/d", _taker(got), width=100).run(events)
    second = {r["key"]: (r["seq"], r["sent"]) for r in delivery.Delivery(spark, f"{folder}/d", None).acknowledged(ACKS).collect()}
    assert second == {"hot": (499, 499), "a": (700, 2), "b": (650, 1)}
    taken = {f.name: [int(x) for x in f.read_text().split()] for f in got.iterdir()}
    assert taken == {"hot": list(range(1, 500)), "a": [601, 700], "b": [650]}


def test_delivery_of_nothing(spark, folder):
    sent = delivery.Delivery(spark, f"{folder}/d", lambda *a: True)
    sent.run(spark.createDataFrame([], "key string, seq bigint, value string"))
    assert sent.acknowledged(ACKS).isEmpty()


# ---- the partitioned log ---------------------------------------------------------------------------


def test_log_scans_are_pruned(spark, folder):
    log = spark.createDataFrame([(i, 1, "a" if i % 3 else "b", None, "{}") for i in range(3000)], schemas.CHANGE_LOG)
    changelog.write_changes(log.where("change_id < 2000"), folder, width=500)
    changelog.write_changes(log.where("change_id >= 2000"), folder, width=500)
    found = changelog.read_changes(spark, folder, "b", 2500)
    assert sorted(r["change_id"] for r in found.collect()) == [i for i in range(2501, 3000) if i % 3 == 0]
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(table_name" in plan and "GreaterThan(change_id,2500)" in plan
    assert found.columns and set(found.columns) == set(schemas.CHANGE_LOG.fieldNames())


# ---- sketches --------------------------------------------------------------------------------------


def test_sketches_of_versions_are_merged(spark, folder):
    rng = random.Random(4)
    rows = [(v, "hot" if i % 3 else "b", rng.gauss(10 * v, 3)) for v in range(4) for i in range(4000)]
    df = spark.createDataFrame(rows, "version int, query string, seconds double")
    for v in range(4):
        stats.add_sketches(df.where(F.col("version") == v), folder, "version", "query", "seconds")
    merged = stats.merged_sketches(spark.read.parquet(folder), "query")
    told = stats.within_bounds(merged, df, "query", "seconds", (0.01, 0.5, 0.95)).collect()
    assert len(told) == 6 and all(r["within"] for r in told) and {r["n"] for r in told if r["query"] == "b"} == {sum(q == "b" for _, q, _ in rows)}
    shifted = df.withColumn("seconds", F.col("seconds") + 5)
    assert not all(r["within"] for r in stats.within_bounds(merged, shifted, "query", "seconds", (0.5,)).collect())


@pytest.mark.parametrize("name", ["replica_repair", "upsert_batches", "delivered_events", "log_after"])
def test_registered_rows_on_an_empty_table(spark, name, folder):
    from tributary.plans import movement

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(0).write.parquet(f"{folder}/events.parquet")
    assert movement.QUERIES[name](spark, folder).collect() == []


def test_rounds_are_as_many_as_the_longest_key_needs(spark, folder, tmp_path):
    got = tmp_path / "got"
    got.mkdir()
    many = [(f"k{i % 40}", i, "v") for i in range(4000)]
    events = spark.createDataFrame(many + [("long", 9000 + 7 * i, "v") for i in range(250)] + [(None, 5, "v")], "key string, seq bigint, value string").repartition(5)
    delivery.Delivery(spark, f"{folder}/d", _taker(got), width=100).run(events)
    acks = spark.read.parquet(f"{folder}/d/acks")  # a row per key and round
    rounds = {r["key"]: r["count"] for r in acks.groupBy("key").count().collect()}
    assert {k: n for k, n in rounds.items() if k != "long"} == {None: 1} | {f"k{i}": 1 for i in range(40)}
    assert 2 <= rounds["long"] <= 3
    taken = {f.name: [int(x) for x in f.read_text().split()] for f in got.iterdir()}
    assert taken["long"] == [9000 + 7 * i for i in range(250)] and taken["k3"] == list(range(3, 4000, 40)) and taken["None"] == [5]


def test_sketches_of_many_versions_are_few_files(spark, folder):
    df = spark.range(40_000).selectExpr("cast(id / 100 as int) as version", "if(id % 3 = 0, 'a', 'b') as query", "cast(id as double) as seconds")
    stats.add_sketches(df, f"{folder}/s", "version", "query", "seconds")
    stored = spark.read.parquet(f"{folder}/s")
    assert stored.count() == 800 and stored.select("version").distinct().count() == 400
    assert len(stored.inputFiles()) <= 8  # of shuffle partitions, not of versions
    told = stats.within_bounds(stats.merged_sketches(stored, "query"), df, "query", "seconds", (0.5, 0.95)).collect()
    assert len(told) == 4 and all(r["within"] for r in told) and {r["n"] for r in told} == {13334, 26666}
