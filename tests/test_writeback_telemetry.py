import pytest
from pyspark.sql import functions as F

from tests.helpers import tuples
from tributary.operators import telemetry, writeback


def outbox(spark, *rows):
    return spark.createDataFrame(list(rows), "src string, seq bigint, payload string")


def test_flush_stops_at_the_first_failure_and_resumes(spark):
    box = outbox(spark, *[("e", n, f'{{"n":{n}}}') for n in range(1, 6)], ("f", 1, "plain"))
    acks = box.select("src", "seq").limit(0)
    page = writeback.next_page(writeback.pending(box, acks))
    sent = writeback.deliver(page, lambda body: body["id"] != "e-3")
    assert tuples(sent) == [("e", 1), ("e", 2), ("f", 1)]
    left = writeback.pending(box, sent)
    assert tuples(left.select("src", "seq")) == [("e", 3), ("e", 4), ("e", 5)]
    again = writeback.deliver(writeback.next_page(left), lambda body: True)
    assert tuples(again) == [("e", 3), ("e", 4), ("e", 5)]

    def refuse(body):
        raise IOError("down")

    assert writeback.deliver(page, refuse).count() == 0


def test_delivered_prefix_matches_delivery(spark):
    box = outbox(spark, *[(s, n, "x" * (n % 4)) for s in ("a", "b", "c") for n in range(1, 4 if s == "c" else 9)])
    ok = F.length("payload") > 0
    prefix = writeback.delivered_prefix(writeback.next_page(box), ok).select("src", "seq")
    sent = writeback.deliver(writeback.next_page(box), lambda body: body["payload"] != '""')
    assert tuples(prefix) == tuples(sent) == [(s, n) for s in "abc" for n in (1, 2, 3)]


def test_page_takes_the_oldest_of_each_source(spark):
    box = outbox(spark, *[("hot", n, "{}") for n in range(2500)], ("cold", 7, "{}"))
    page = writeback.next_page(box)
    assert {r.src: (r.n, r.top) for r in page.groupBy("src").agg(F.count("*").alias("n"), F.max("seq").alias("top")).collect()} == {"hot": (1000, 999), "cold": (1, 7)}


def test_messages_and_inbox(spark):
    box = outbox(spark, ("e", 1, '{"a":1}'), ("e", 2, 'say "x"'))
    assert tuples(writeback.message(box)) == [("e-1", "e", 1, '{"a":1}'), ("e-2", "e", 2, '"say \\"x\\""')]
    twice = spark.createDataFrame([("e-1", "e", 1, "old"), ("e-1", "e", 2, "new"), ("e-2", "e", 1, "x")], "id string, src string, seq bigint, payload string")
    assert tuples(writeback.landed(twice).select("id", "payload")) == [("e-1", "new"), ("e-2", "x")]


def log(spark, **nodes):
    rows = [(n, i, line) for n, lines in nodes.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "node string, position bigint, line string").withColumn("touched", F.current_timestamp())


MASTER = [
    'source=wikimedia wiki="enwiki" ns="0" max=0 ', "  stored=32  rate=3.5/s  (pushed)", "  put failed (skipping x): e",
    "  stored=64  rate=4.0/s  (pushed)", "  push failed: e", "  wikimedia stream dropped: eof; reconnecting in 3s",
    "stored=999 rate=9/s without push",
]
REPLICA = ["pulled changed=false", "[retrieval] 12.5 ms", "[retrieval] scan 7.25ms  embed 3ms", "pulled changed=true"]


def test_node_metrics(spark):
    got = {r.node: r for r in telemetry.node_metrics(log(spark, m=MASTER, r=REPLICA, e=["hello"])).collect()}
    m, r, e = got["m"], got["r"], got["e"]
    assert (m.stored, m.rate_per_s, m.pushed_batches, m.push_failed, m.put_failed, m.reconnects) == (64, 4.0, 2, 1, 1, 1)
    assert m.source == 'source=wikimedia wiki="enwiki" ns="0" max=0'
    assert (r.searches, r.last_retrieval_ms, r.last_pull_changed) == (2, 7.25, "true")
    assert (e.stored, e.rate_per_s, e.source, e.searches, e.last_retrieval_ms, e.last_pull_changed) == (0, 0.0, "", 0, None, None)


def test_errors_classes_and_up(spark):
    lines = log(spark, m=MASTER + ["PANIC here"] * 50, r=REPLICA)
    errors = telemetry.error_lines(lines).groupBy("node").count()
    assert tuples(errors) == [("m", 40)]
    assert dict(((r.node, r["class"]), r.c) for r in telemetry.line_classes(lines).collect()) == {
        ("m", "err"): 53, ("m", "ok"): 2, ("m", ""): 2, ("r", "ok"): 2, ("r", ""): 2
    }
    assert tuples(telemetry.node_up(lines, F.current_timestamp())) == [("m", True), ("r", True)]
    later = F.current_timestamp() + F.expr("interval 31 seconds")
    assert tuples(telemetry.node_up(lines, later)) == [("m", False), ("r", False)]


COLUMNS = "node string, role string, up boolean, errors bigint, pushed_batches bigint, push_failed bigint, searches bigint, last_retrieval_ms double"


@pytest.mark.parametrize(
    "nodes, verdict, level",
    [
        ([("r", "replica", True, 0, 0, 0, 3, 1.0)], "no master", "bad"),
        ([("m", "master", True, 0, 5, 1, 0, None)], "pushes failing", "warn"),
        ([("m", "master", True, 0, 5, 0, 0, None)], "no replica", "warn"),
        ([("m", "master", True, 0, 5, 0, 0, None), ("r", "replica", True, 0, 0, 0, 3, 1.0)], "healthy", "ok"),
        ([("m", "master", True, 0, 5, 0, 0, None), ("r", "replica", True, 0, 0, 0, 0, None)], "no searches yet", "warn"),
        ([("m", "master", True, 0, 0, 0, 0, None), ("r", "replica", True, 0, 0, 0, 3, 1.0)], "not pushing yet", "warn"),
    ],
)
def test_fleet_verdicts(spark, nodes, verdict, level):
    row = telemetry.fleet_rollup(spark.createDataFrame(nodes, COLUMNS)).first()
    assert (row.verdict, row.level) == (verdict, level)


def test_fleet_figures(spark):
    nodes = [
        ("m1", "master", False, 0, 5, 0, 100, 9.0), ("m2", "master", False, 0, 7, 3, 0, None),
        ("r1", "replica", True, 2, 0, 0, 3, 1.0), ("r2", "replica", False, 0, 0, 0, 4, 2.0), ("r3", "replica", False, 0, 0, 0, 0, None),
    ]
    row = telemetry.fleet_rollup(spark.createDataFrame(nodes, COLUMNS)).first()
    assert (row.masters, row.replicas, row.searches, row.any_up, row.replica_up, row.any_error) == (2, 3, 7, True, True, True)
    assert (row.last_retrieval_ms, row.pushed_batches, row.push_failed) == (2.0, 5, 0)
