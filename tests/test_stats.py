import math
import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import tuples
from tributary.operators import grouping, results, stats


def brute(values, share):
    ordered = sorted(values)
    return ordered[min(math.floor(len(ordered) * share), len(ordered) - 1)]


def test_order_statistics_equal_sorting(spark):
    rng = random.Random(5)
    groups = {f"n{n}": [rng.random() for _ in range(n)] for n in (1, 2, 3, 7, 20, 21, 100, 999, 30_000)}
    groups["same"] = [4.0] * 5000
    groups["few"] = [float(rng.randrange(3)) for _ in range(20_000)]
    groups["wide"] = [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(20_000)]
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = stats.order_statistics(spark.createDataFrame(rows, "g string, v double"), "g", "v", shares)
    assert {(r.g, r.share): r.v for r in got.collect()} == {
        (g, s): brute(vs, s) for g, vs in groups.items() for s in shares
    }


def test_order_statistics_with_a_coarse_sketch(spark):
    rng = random.Random(6)
    values = [rng.gauss(0, 1) for _ in range(50_000)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double").repartition(9)
    got = stats.order_statistics(df, "g", "v", [0.5, 0.95], accuracy=50)
    assert {r.share: r.v for r in got.collect()} == {s: brute(values, s) for s in (0.5, 0.95)}


def test_latency_summary_of_twenty_samples(spark):
    df = spark.createDataFrame([("q", i / 1000) for i in range(1, 21)], "query string, seconds double")
    assert tuple(stats.latency_summary(df).first()) == ("q", 20, 11.0, 20.0, 10.5)


def test_best_of_and_rates(spark):
    runs = spark.createDataFrame([("a", 3.0), ("a", 2.0), ("b", 1.0)], "query string, seconds double")
    assert tuples(stats.best_of(runs)) == [("a", 2.0, 2), ("b", 1.0, 1)]
    events = spark.sql("SELECT timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 2) AS ts FROM range(10)")
    row = stats.docs_per_minute(events).first()
    assert (row.n, row.event_window_s) == (10, 18.0) and row.docs_per_min == pytest.approx(33.333, abs=1e-3)
    assert stats.docs_per_minute(events.limit(1)).first()["docs_per_min"] == 0.0


def test_capture_overhead(spark):
    runs = spark.createDataFrame([("off", 307333.0, 34385920.0), ("on", 172956.0, 69058560.0)], "mode string, rate double, bytes double")
    assert tuple(stats.capture_overhead(runs).first()) == (43.7, 2.01, 1.8)


def test_recall(spark):
    truth = spark.createDataFrame([(q, i) for q in (1, 2) for i in range(10)], "query_id int, id int")
    found = spark.createDataFrame([(1, i) for i in range(10)] + [(2, i) for i in range(5, 15)], "query_id int, id int")
    assert tuple(stats.recall(found, truth, 10).first()) == (2, 0.75)


def test_footprint_counts_bytes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a").write_bytes(b"x" * 100)
    (tmp_path / "sub" / "b").write_bytes(b"x" * 11)
    assert tuple(stats.footprint(spark, str(tmp_path)).first()) == (2, 111)


def test_top_and_joined_counts(spark):
    facts = spark.createDataFrame([("p1",)] * 50 + [("p2",)] * 3 + [("p3",)] * 3 + [(None,)] * 9 + [("gone",)], "k string")
    dim = spark.createDataFrame([("p1", "A"), ("p2", "B"), ("p3", "C"), ("p4", "D"), ("p5", None)], "pk string, g string")
    assert tuples(grouping.top_groups(facts, "k", 2)) == [("p1", 50), ("p2", 3)]
    assert [tuple(r) for r in grouping.count_by(facts, "k").collect()] == [(None, 9), ("gone", 1), ("p1", 50), ("p2", 3), ("p3", 3)]
    assert [tuple(r) for r in grouping.top_joined(facts, "k", dim, "pk", "g").collect()] == [("A", 50), ("B", 3), ("C", 3)]


def test_hit_display(spark):
    hits = spark.createDataFrame([("a", "t", '{"title":"T","url":"u"}'), ("b", "t", "{}"), ("c", "t", "{oops"), ("d", "t", None)], "id string, text string, meta string")
    assert tuples(grouping.hit_display(hits).select("id", "title", "url")) == [("a", "T", "u"), ("b", "t", ""), ("c", "t", ""), ("d", "t", "")]


def test_run_results(spark, folder):
    results.save(spark, folder, "r1", "scan", {"seconds": 2.0, "rows": 10})
    results.save(spark, folder, "r2", "scan", {"seconds": 1.0})
    assert tuples(results.latest(spark, folder)) == [("scan", "rows", 10.0, "r1"), ("scan", "seconds", 1.0, "r2")]
    assert results.load(spark, folder, "r1").count() == 2


def test_capture_cost_reports_all_ways(spark, folder):
    rows = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("t"))
    got = {r.stack: r for r in results.capture_cost(spark, rows, "id", folder).collect()}
    assert {k: (r.rows, r.cdc_events_captured) for k, r in got.items()} == {"none": (500, 0), "full": (500, 500), "shadow": (500, 500)}
    assert got["full"].storage_bytes > got["none"].storage_bytes
    broken = results.capture_cost(spark, rows.withColumn("change_type", F.lit("x")), "id", folder + "/2")
    notes = {r.stack: r.notes for r in broken.collect()}
    assert notes["none"] is None and notes["shadow"].startswith("unsupported")
