import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import tuples
from tributary import tables
from tributary.engine import Engine
from tributary.operators import embedding
from tributary.sources import feeds
from tributary.streaming import sinks


@pytest.fixture
def engine(spark, folder):
    return Engine(spark, f"{folder}/master", embedding.hash_model(384))


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_demo_corpus_end_to_end(spark, folder, engine):
    """The gate of a build: six documents in, six drained, the right one found."""
    engine.put_many(feeds.demo_documents(spark))
    upsert = sinks.UpsertSink(tables.MergeTable(spark, f"{folder}/olap"))
    stats = engine.drain([upsert])
    assert stats.changes == 6 and upsert.documents().count() == 6
    hits = engine.search(ask(spark, "what replaces kafka and debezium"), 3).orderBy("rank").collect()
    assert len(hits) == 3 and "tide-2" in [h.id for h in hits]
    assert tuples(engine.summary()) == [("demo", 6, 6)]
    timed, embed_ms, scan_ms = engine.search_timed(["what replaces kafka and debezium"], 3)
    assert [h.id for h in timed] == [h.id for h in hits] and embed_ms >= 0 and scan_ms > 0


def test_put_update_delete(spark, folder, engine):
    base = embedding.hash_model(384)
    engine.put("a", "alpha", '{"source":"s1"}')
    engine.put("b", "beta")
    engine.put("a", "alpha two", '{"source":"s2"}')
    engine.put("a", "alpha two", '{"source":"s3"}')
    engine.delete(spark.createDataFrame([("b",), ("nobody",)], "id string"))
    docs = engine.documents().collect()
    assert [(r.id, r.text, r.meta) for r in docs] == [("a", "alpha two", '{"source":"s3"}')]
    vectors = engine.vectors().collect()
    assert ids(engine.vectors()) == ["a"]
    assert vectors[0].emb == pytest.approx(list(base(["alpha two"])[0]))
    log = engine.log.read().orderBy("change_id")
    assert [r.change_type for r in log.collect()] == [1, 1, 0, 0, -1]


def test_repeated_ids_in_one_put(spark, engine):
    rows = [("a", "old", None, 1), ("a", "new", None, 2), ("b", "only", None, 1)]
    engine.put_many(spark.createDataFrame(rows, "id string, text string, meta string, n int"), order="n")
    assert [r[:2] for r in tuples(engine.documents())] == [("a", "new"), ("b", "only")]
    with pytest.raises(ValueError, match="'a' stands in the batch 2 times"):
        engine.put_many(spark.createDataFrame(rows, "id string, text string, meta string, n int"))


def test_repeated_ids_in_one_inbox_batch(spark, engine):
    rows = spark.createDataFrame([("m", "s", str(i), i) for i in range(40)], "id string, src string, payload string, n int")
    with pytest.raises(ValueError, match="40 times"):
        engine.ingest_inbox(rows)
    for parts in (1, 8):
        engine.ingest_inbox(rows.repartition(parts), order="n")
        assert [r.payload for r in engine.inbox().collect()] == ["39"]


def test_a_put_reads_the_buckets_it_touches(spark, engine):
    engine.put_many(spark.createDataFrame([(f"k{i}", f"text {i}", None) for i in range(200)], "id string, text string, meta string"))
    engine.compact(expire=True)
    engine.put("k7", "new text")
    assert engine.table.deltas.touched(0, 1) == engine.table.deltas.touched(-1, 1)
    assert len(engine.table.deltas.touched(0, 1)) == 1
    docs = {r.id: r.text for r in engine.documents().collect()}
    assert len(docs) == 200 and docs["k7"] == "new text"


def test_a_feed_lands_in_the_log_once(spark, folder, engine):
    event = {"type": "edit", "wiki": "w", "namespace": 0, "title": "T", "comment": "c"}
    for n, (id_, title) in enumerate([("e1", "T1"), ("e2", "T2"), ("e1", "T3")]):
        line = "data: " + json.dumps(event | {"title": title, "meta": {"id": id_}})
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{folder}/landing/{n}")
    read = spark.readStream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).text(f"{folder}/landing")
    told = []
    options = {"push_writes": 2, "publish": lambda: told.append(engine.log.newest())}
    engine.land(read, lambda df: feeds.edit_documents(df, "w", "0"), "wiki", **options).awaitTermination()
    assert {r.id: r.text for r in engine.documents().collect()} == {"e1": "T3: c", "e2": "T2: c"} and told == [1]
    before = engine.log.newest()
    batch = spark.createDataFrame([("x", "again", None)], "id string, text string, meta string")
    assert engine.put_many(batch, tag="wiki:1") == 1 and engine.log.newest() == before


def test_a_put_that_died_after_the_log_is_completed(spark, engine, monkeypatch):
    engine.put("a", "alpha")
    monkeypatch.setattr(engine.table, "apply", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        engine.put("b", "beta")
    monkeypatch.undo()
    assert ids(engine.documents()) == ["a"]
    engine.put("c", "gamma")
    assert ids(engine.documents()) == ids(engine.vectors()) == ["a", "b", "c"]


def test_replica_pulls_finished_vectors(spark, folder, engine):
    replica = Engine(spark, f"{folder}/replica", embedding.hash_model(384))
    assert not replica.pull(engine)
    engine.put("a", "alpha")
    assert replica.pull(engine) and not replica.pull(engine)
    engine.put("b", "beta")
    assert not replica.converged_with(engine).first()["consistent"]
    assert replica.pull(engine)
    assert replica.converged_with(engine).first()["consistent"]
    assert replica.search(ask(spark, "beta"), 1).first()["id"] == "b"


def test_vectors_of_another_model_are_refused(spark, folder, engine):
    engine.put("a", "alpha")
    other = Engine(spark, f"{folder}/master", embedding.hash_model(384), model_name="other")
    with pytest.raises(Exception, match="query model other, stored model hash-384"):
        other.search(ask(spark, "alpha"), 1).collect()


def test_answers(spark, folder, engine):
    engine.put_many(feeds.demo_documents(spark))
    silent = engine.answer(ask(spark, "what replaces kafka?"), 2).first()
    assert silent.answer == "" and "[2] " in silent.prompt
    engine.generator = lambda prompts: [f"{len(p)} letters" for p in prompts]
    row = engine.answer(ask(spark, "what replaces kafka?"), 2).first()
    assert row.answer == f"{len(row.prompt)} letters"


def test_prune_removes_only_what_every_consumer_has(spark, folder, engine):
    sink = sinks.UpsertSink(tables.MergeTable(spark, f"{folder}/olap"))
    lake = sinks.LakeSink(spark, f"{folder}/lake")
    engine.put("a", "alpha")
    engine.drain([sink])
    engine.put("b", "beta")
    engine.drain([lake], name="lake")
    assert engine.drained() == {"lake": 1, "main": 0}
    assert engine.prune() == 1
    assert engine.drain([sink]).changes == 1
    assert engine.prune(upto=0) == 0 and engine.prune() == 1
    engine.put("c", "gamma")
    assert engine.drain([sink]).changes == 1 and engine.drain([lake], name="lake").changes == 1
    assert ids(sink.documents()) == ids(engine.documents()) == ids(lake.rows()) == ["a", "b", "c"]


def test_write_back(spark, folder, engine):
    edge = Engine(spark, f"{folder}/edge")
    edge.enqueue(['{"n":1}', "two"], src="e1")
    edge.enqueue(["three"], src="e1")
    assert tuples(edge.outbox_pending().select("src", "seq", "payload")) == [("e1", 1, '{"n":1}'), ("e1", 2, "two"), ("e1", 3, "three")]
    assert edge.flush_outbox(lambda body: body["id"] != "e1-3") == 2
    assert edge.flush_outbox(lambda body: body["id"] != "e1-3") == 0
    assert edge.flush_outbox(lambda body: True) == 1
    assert edge.outbox_pending().count() == 0
    messages = spark.createDataFrame([("e1-1", "e1", '{"n":1}'), ("e1-2", "e1", '"two"')], "id string, src string, payload string")
    engine.ingest_inbox(messages)
    engine.ingest_inbox(messages.withColumn("payload", F.lit('"again"')).limit(1))
    assert tuples(engine.inbox().select("id", "src", "payload")) == [("e1-1", "e1", '"again"'), ("e1-2", "e1", '"two"')]


def test_texts_are_embedded_in_one_pass_over_the_changes(spark, folder):
    def model(texts):
        assert all(t in ("one", "two", "three") for t in texts), texts
        return [[float(len(t)), 1.0] for t in texts]

    engine = Engine(spark, f"{folder}/e", model, "lengths")
    engine.put_many(spark.createDataFrame([("a", "one", None), ("b", "two", None)], "id string, text string, meta string"))

    def later(texts):  # texts that have a vector do not come again
        assert all(t == "three" for t in texts), texts
        return model(texts)

    engine.model = later
    rows = "id string, change_id bigint, op string, text string, meta string, ts bigint"
    changed = [("a", 9, "update", "one", None, 1), ("b", 9, "update", "three", None, 1), ("c", 9, "delete", None, None, None)]
    found = engine._with_vectors(spark.createDataFrame(changed, rows))
    assert {r["id"]: r["emb"] for r in found.collect()} == {"a": [3.0, 1.0], "b": [5.0, 1.0], "c": None}
    assert "Union" not in engine._with_vectors(spark.createDataFrame(changed, rows).where("ts > 0"))._jdf.queryExecution().analyzed().toString().split("Join LeftOuter")[0]
