import json
import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import change_log, doc, tuples
from tributary.operators import changes, replication

I, U, D = 1, 0, -1


def replay(rows):
    """Sequential application of decoded changes: id -> image."""
    state = {}
    for _, op, id_, before_id, image in sorted(rows, key=lambda r: r[0]):
        if op == "update" and before_id not in (None, id_):
            state.pop(before_id, None)
        if op == "delete":
            state.pop(id_, None)
        else:
            state[id_] = image
    return state


def random_log(seed, n=400, keys=12, hot=0.4):
    """A log in which one key owns a large share of the changes; now and then an update moves a key."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < hot else f"k{rng.randrange(keys)}"
        code = rng.choice([I, U, U, D])
        before = doc(key, f"b{i}") if code != I else None
        target = f"k{rng.randrange(keys)}" if code == U and rng.random() < 0.1 else key
        after = doc(target, f"a{i}", ts=i) if code != D else None
        rows.append((i, code, before, after))
    return rows


def test_decode_and_reasons(spark):
    log = change_log(
        spark, (1, 2, None, doc("a")), (2, None, None, doc("a")), (3, I, doc("a"), None), (4, D, None, doc("a")),
        (5, I, None, "{oops"), (6, U, "{oops", doc("b")), (7, D, doc("c"), "{oops"), (8, I, None, {"text": "no key"}),
        (9, I, None, {"id": 5}),
    )
    got = changes.decode(log).select("change_id", "op", "id", F.col("before").isNotNull(), F.col("after").isNotNull())
    assert tuples(got) == [
        (6, "update", "b", False, True), (7, "delete", "c", True, False),
        (8, "insert", "", False, True), (9, "insert", "", False, True),
    ]
    assert dict(tuples(changes.skipped_by_reason(log))) == {
        "unknown change type": 2, "no row image": 2, "image is not JSON": 1
    }
    assert dict(tuples(changes.op_counts(changes.decode(log)))) == {"insert": 2, "update": 1, "delete": 1}


def test_strict_decode_fails_on_a_broken_image(spark):
    with pytest.raises(Exception, match="change 2: image is not JSON"):
        changes.decode_strict(change_log(spark, (1, I, None, doc("a")), (2, I, None, "{oops"))).collect()
    fine = changes.decode_strict(change_log(spark, (1, I, None, doc("a")), (2, I, doc("x"), None), (3, 9, None, "{oops")))
    assert fine.count() == 1


def test_fold_cases(spark):
    log = change_log(
        spark, (1, I, None, doc("a")), (2, U, doc("a"), doc("a")), (3, D, doc("a"), None),
        (4, I, None, doc("b", "first")), (5, U, doc("b"), doc("b", "last")),
        (6, I, None, doc("c")), (7, D, doc("c"), None), (8, I, None, doc("c", "again")),
    )
    folded = changes.fold(changes.effects(changes.decode(log)))
    assert tuples(changes.document_rows(folded)) == [("b", "last", "", 0), ("c", "again", "", 0)]


@pytest.mark.parametrize("seed", range(3))
def test_fold_equals_sequential_replay(spark, seed):
    rows = random_log(seed)
    decoded = changes.decode(change_log(spark, *rows).repartition(5))
    want = replay(
        (i, {I: "insert", U: "update", D: "delete"}[c], (b if c == D else a)["id"], b and b["id"], a)
        for i, c, b, a in rows
    )
    folded = changes.fold(changes.effects(decoded, leave=False))
    got = {r.id: json.loads(r.image) for r in changes.live(folded).collect()}
    assert got == want
    left = changes.live(changes.fold(changes.effects(decoded)))
    assert {r.id for r in left.collect()} >= set(want)
    # In two steps, and with the second step applied twice, the result is the same.
    effects = changes.effects(decoded)
    old, delta = replication.snapshot(effects, 200), replication.increment(effects, 200)
    once = changes.upsert_into(old, delta)
    twice = changes.upsert_into(once, delta)
    late = changes.upsert_into(folded, replication.increment(effects, 0, 100))
    for other in (once, twice, late):
        assert changes.same_content(folded, other).first()["consistent"]
    assert replication.convergence(folded, once).first()["converged"]
    assert not replication.convergence(folded, old).first()["converged"]


def brute_violations(rows, leave):
    live, bad = set(), set()
    for i, code, before, after in rows:
        key = (before if code == D else after)["id"]
        if code == U and before["id"] != key:
            bad.add((key, i, "update changes the key"))
            if not leave:
                live.discard(before["id"])
        if code == I and key in live:
            bad.add((key, i, "insert on a live key"))
        if code == D:
            live.discard(key)
        else:
            live.add(key)
    return bad


@pytest.mark.parametrize("seed, width", [(1, 7), (2, 64), (3, 1_000_000)])
def test_violations_equal_brute_force(spark, seed, width):
    rows = random_log(seed)
    for leave in (True, False):
        found = changes.violations(changes.decode(change_log(spark, *rows)), width=width, leave=leave)
        assert set(tuples(found)) == brute_violations(rows, leave)


def test_violations_against_existing_rows(spark):
    decoded = changes.decode(change_log(spark, (5, I, None, doc("a")), (6, I, None, doc("b")), (7, I, None, doc("b"))))
    existing = spark.createDataFrame([("a",), ("z",)], "id string")
    assert [r[:2] for r in tuples(changes.violations(decoded, existing))] == [("a", 5), ("b", 7)]


def test_previous_value_crosses_stretches(spark):
    rows = [("a", i, f"v{i}") for i in (1, 2, 9, 30, 31)] + [("b", 9, "w")]
    df = spark.createDataFrame(rows, "k string, n bigint, v string")
    got = {(r.k, r.n): r.previous for r in changes.with_previous(df, "k", "n", "v", width=10).collect()}
    assert got == {("a", 1): None, ("a", 2): "v1", ("a", 9): "v2", ("a", 30): "v9", ("a", 31): "v30", ("b", 9): None}


def test_diff_applied_to_the_old_version_gives_the_new(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", None, "y"), ("c", 3, None), ("d", 4, "w")], "id string, n int, t string")
    new = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, None), ("e", 5, None)], "id string, n int, t string")
    full = {r.id: r for r in changes.capture_diff(old, new, "id", "t", "full").collect()}
    assert {k: r.change_type for k, r in full.items()} == {"b": U, "d": D, "e": I}
    assert json.loads(full["b"].before) == {"id": "b", "n": None, "t": "y"}
    assert full["e"].before is None and full["d"].after is None
    state = {r.id: tuple(r) for r in old.collect()}
    for key, r in full.items():
        state.pop(key, None)
        if r.after is not None:
            state[key] = tuple(json.loads(r.after).values())
    assert state == {r.id: tuple(r) for r in new.collect()}
    shown = {
        mode: [(r.before is not None, r.after is not None) for r in changes.capture_diff(old, new, "id", "t", mode).orderBy("id").collect()]
        for mode in changes.MODES
    }
    assert shown == {
        "off": [], "id": [(False, False)] * 3, "before": [(True, False), (True, False), (False, False)],
        "after": [(False, True), (False, False), (False, True)], "full": [(True, True), (True, False), (False, True)],
    }
    with pytest.raises(ValueError, match="unknown capture mode"):
        changes.capture_diff(old, new, "id", "t", "some")


def test_lake_keeps_every_image_and_merged_keeps_none(spark):
    decoded = changes.decode(change_log(spark, (1, I, None, doc("a")), (2, U, doc("a"), doc("a")), (3, D, doc("a"), None)))
    assert changes.lake_rows(decoded).count() == 2
    assert changes.live(changes.fold(changes.effects(decoded))).count() == 0


def test_content_hash_sees_repeats_and_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "n int, t string")
    assert changes.same_content(a, a.orderBy(F.desc("n")).select("t", "n")).first()["consistent"]
    assert not changes.same_content(a, a.union(a).union(a)).first()["consistent"]
    assert not changes.same_content(a, a.withColumn("t", F.upper("t"))).first()["consistent"]
    assert changes.same_content(a.limit(0), a.limit(0)).first()["consistent"]


def test_events_embed_images(spark):
    decoded = changes.decode(change_log(spark, (1, U, doc("a", 'q"'), doc("a", "n")), (2, D, doc("b"), None)))
    events = [json.loads(r.value) for r in changes.change_events(decoded).orderBy("change_id").collect()]
    assert events == [
        {"op": "update", "table": "docs", "id": "a", "after": doc("a", "n"), "before": doc("a", 'q"')},
        {"op": "delete", "table": "docs", "id": "b", "after": None, "before": doc("b")},
    ]


def test_pruned_log(spark):
    log = change_log(spark, *[(i, I, None, doc("a")) for i in range(5)])
    assert sorted(r.change_id for r in changes.remaining(log, 2).collect()) == [3, 4]
    assert changes.remaining(log, None).count() == 0
