"""Benchmark: headline queries on the test tables, then the published workload at its own size.

Prints one JSON line. Settings: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEATS (default 2; the fastest run counts), BENCH_WORKLOAD=0 to leave out the second part.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tributary import tables  # noqa: E402
from tributary.operators import changes, embedding, grouping, ivf, knn, results, stats  # noqa: E402
from tributary.plans import catalogue  # noqa: E402
from tributary.session import local_session, shared_dir  # noqa: E402
from tributary.sources import star  # noqa: E402
from tributary.streaming import drain as draining  # noqa: E402
from tributary.streaming import sinks  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
BUDGET = float(os.environ.get("BENCH_BUDGET", "270"))  # seconds after which no further part is started
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))

HEADLINE = """
q1_top_groups q2_count_by_year q3_top_sections q4_most_referenced q5_join_count summary_by_source json_group_count
latency_summary event_rate_1min cdc_op_counts cdc_fold cdc_upsert_snapshot cdc_violations cdc_append_vs_merged
snapshot_diff_full replica_converged outbox_prefix inbox_upsert stream_drain hash_embed_buckets hash_embed_vector
knn_exact knn_centroids search_with_text rag_prompt prep_patents prep_cpc firehose_docs log_metrics
fleet_rollup
""".split()

PATENTS = 50_000  # size of the published workload


def headline(spark) -> dict[str, float]:
    queries = catalogue.queries()
    return {
        name: round(results.timed(lambda: results.run_to_end(queries[name](spark, SF_DIR)), REPEATS), 4)
        for name in HEADLINE
    }


def patent_load(spark, n: int):
    """``n`` patents computed from a counter, with titles and texts of the test tables."""
    x = F.col("id")
    parts = spark.read.parquet(f"{SF_DIR}/part.parquet").select(F.col("p_partkey").alias("k"), "p_name", "p_brand")
    texts = spark.read.parquet(f"{SF_DIR}/documents.parquet").select(F.col("doc_id").alias("d"), F.substring("text", 1, 600).alias("abstract"))
    size, docs = parts.count(), texts.count()
    rows = spark.range(n).join(parts, x % size == F.col("k")).join(texts, x % docs == F.col("d"))
    return rows.select(
        F.concat(F.lit("US-"), x + 9_000_000, F.lit("-B2")).alias("patent_id"), F.col("p_name").alias("title"), "abstract",
        F.concat("p_brand", F.lit(" "), x % 160).alias("assignee"), F.concat((2015 + x % 11).cast("string"), F.lit("-01-01")).alias("grant_date"),
        (2015 + x % 11).cast("int").alias("grant_year"), (x % 30_000).cast("int").alias("claims_len"),
        (x % 46 + 1).cast("int").alias("n_cpc"), (x % 78).cast("int").alias("n_citations"),
    )


def counter_load(spark, n: int):
    """The capture workload: short rows computed from a counter."""
    x = F.col("id")
    return spark.range(1, n + 1).select(
        F.concat(F.lit("P"), x).alias("patent_id"), F.concat(F.lit("title "), x).alias("title"),
        F.concat(F.lit("abstract "), x).alias("abstract"), F.concat(F.lit("assignee "), x % 1000).alias("assignee"),
        F.lit("2020-01-01").alias("grant_date"), F.lit(2020).alias("grant_year"), (x % 50 + 1).cast("int").alias("claims_len"),
        (x % 8 + 1).cast("int").alias("n_cpc"), (x % 30).cast("int").alias("n_citations"),
    )


def load_star(spark, folder: str) -> dict:
    """Generate the star, write it, read it back by name."""
    start = time.monotonic()
    patents = patent_load(spark, PATENTS)
    codes = patents.select("patent_id", F.explode(F.sequence(F.lit(1), F.col("n_cpc"))).alias("j"))
    section = F.substring(F.lit("ABCDEFGHY"), F.pmod(F.xxhash64("patent_id"), F.lit(9)).cast("int") + 1, F.lit(1))
    code = F.concat(section, F.format_string("%02d", F.col("j")), F.lit("B/01"))
    cited = patents.where("n_citations > 0").select("patent_id", F.explode(F.sequence(F.lit(1), F.col("n_citations"))).alias("j"))
    made = {
        "patents": patents,
        "patent_cpc": codes.select("patent_id", code.alias("cpc"), section.alias("cpc_section")),
        "patent_citations": cited.select(
            "patent_id", F.concat(F.lit("US-"), F.pmod(F.xxhash64("patent_id", "j"), F.lit(PATENTS)) + 9_000_000, F.lit("-B2")).alias("cited_id")
        ),
    }
    for name, rows in made.items():
        star.write_table(rows, f"{folder}/{name}.parquet", star.STAR[name])
    rows = sum(r.c for r in stats.row_counts(star.register_star(spark, folder)).collect())
    seconds = time.monotonic() - start
    return {"rows": rows, "seconds": round(seconds, 3), "rows_per_sec": round(rows / seconds)}


def five_queries(spark, folder: str) -> dict:
    patents, cpc, cited = (spark.table(t) for t in ("patents", "patent_cpc", "patent_citations"))
    five = {
        "Q1_top_assignees": lambda: grouping.top_groups(patents, "assignee"),
        "Q2_grants_per_year": lambda: grouping.count_by(patents, "grant_year"),
        "Q3_top_cpc_sections": lambda: grouping.top_groups(cpc, "cpc_section"),
        "Q4_most_cited": lambda: grouping.top_groups(cited, "cited_id"),
        "Q5_citations_by_assignee": lambda: grouping.top_joined(cited, "patent_id", patents, "patent_id", "assignee"),
    }
    return {n: round(results.timed(lambda q=q: results.run_to_end(q()), REPEATS) * 1000, 1) for n, q in five.items()}


def capture(spark, rows, folder: str) -> dict:
    reports = results.capture_cost(spark, rows, "patent_id", folder, REPEATS).collect()
    return {r.stack: {"rows": r.rows, "rows_per_sec": round(r.rows_per_sec), "bytes": r.storage_bytes} for r in reports}


def patent_log(rows, key):
    """An insert-only change log of patent rows."""
    image = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    return rows.select(
        key.cast("bigint").alias("change_id"), F.lit(1).alias("change_type"), F.lit("patents").alias("table_name"),
        F.lit(None).cast("string").alias("before"), image.alias("after"),
    )


def patent_table(spark, path: str) -> tables.MergeTable:
    columns = ", ".join([f"{c} string" for c in changes.PATENT_TEXTS] + [f"{c} int" for c in changes.PATENT_INTS])
    return tables.MergeTable(spark, path, columns, typed=changes.patent_state, buckets=8)


def drain(spark, log, folder: str) -> dict:
    """Drain ``log`` into an upserted table and a lake table."""
    draining.append_changes(spark, log, f"{folder}/log", 0)
    targets = [sinks.UpsertSink(patent_table(spark, f"{folder}/merged")), sinks.LakeSink(spark, f"{folder}/lake")]
    done = draining.drain(spark, f"{folder}/log", targets, f"{folder}/checkpoint", table="patents", key="patent_id")
    return {"changes": done.changes, "seconds": round(done.seconds, 3), "changes_per_sec": round(done.changes_per_second)}


def replicate(spark, log, folder: str) -> dict:
    master, replica = patent_table(spark, f"{folder}/merged"), patent_table(spark, f"{folder}/replica")
    start = time.monotonic()
    tables.bootstrap(master, replica)
    boot = time.monotonic() - start
    later = log.filter(F.col("change_id") % 10 == 0).withColumn("change_id", F.col("change_id") + 10 * PATENTS)
    master.apply(master.typed(changes.effects(changes.decode(later, "patent_id"))), 1)
    start = time.monotonic()
    tables.pull(master, replica)
    pull = time.monotonic() - start
    same = changes.same_content(master.rows(), replica.rows()).first()["consistent"]
    return {
        "bootstrap_rows": PATENTS, "bootstrap_sec": round(boot, 3),
        "delta_rows": PATENTS // 10, "pull_sec": round(pull, 3), "converged": same,
    }


def search(spark, folder: str) -> dict:
    """Exact search over growing corpora and the index, for the published sample of query vectors."""
    vectors = spark.table("patents").select("patent_id", "abstract").withColumnRenamed("patent_id", "id")
    vectors.select("id", embedding.hash_vector(F.col("abstract"), 64).alias("emb")).write.parquet(f"{folder}/vectors")
    corpus = spark.read.parquet(f"{folder}/vectors")
    row = F.expr("cast(substring_index(substring(id, 4), '-', 1) as bigint)")
    sample = corpus.where(row % 2500 == 0).select(F.col("id").alias("query_id"), "emb")
    asked = spark.createDataFrame([tuple(r) for r in sample.collect()], sample.schema)
    curve = results.search_curve(corpus, asked, [1000, 10_000, PATENTS], 10, REPEATS)
    ivf.build(corpus, 64).write(f"{folder}/index")
    stored = ivf.load(spark, f"{folder}/index")
    seconds = results.timed(lambda: results.run_to_end(stored.search(asked, 10, 8)), REPEATS)
    recall = stats.recall(stored.search(asked, 10, 8), knn.nearest(corpus, asked, 10), 10).first()["recall"]
    index = {"rows": PATENTS, "cells": 64, "probes": 8, "seconds": round(seconds, 3), "recall_at_10": recall}
    return {"exact": curve, "index": index}


def workload(spark, deadline: float) -> dict:
    """The published measurements at their own size, and capture and drain at 20 times that; in order, while time is left."""
    folder = f"{shared_dir(spark)}/bench-{uuid.uuid4().hex}"
    number = F.expr("cast(substring_index(substring(patent_id, 4), '-', 1) as bigint)")
    counter = counter_load(spark, 20 * PATENTS)
    parts = {
        "star_generate_and_load": lambda: load_star(spark, folder),
        "queries_ms": lambda: five_queries(spark, folder),
        "capture": lambda: capture(spark, spark.table("patents"), f"{folder}/cost"),
        "drain": lambda: drain(spark, patent_log(spark.table("patents"), number), folder),
        "replication": lambda: replicate(spark, patent_log(spark.table("patents"), number), folder),
        "search": lambda: search(spark, folder),
        "drain_20x": lambda: drain(spark, patent_log(counter, F.expr("substring(patent_id, 2)")), f"{folder}/large"),
        "capture_20x": lambda: capture(spark, counter, f"{folder}/large_cost"),
    }
    return {name: run() if time.monotonic() < deadline else "left out: time" for name, run in parts.items()}


def main() -> None:
    started = time.monotonic()
    spark = local_session(CPUS, app="tributary-bench", memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.queries()["row_counts"](spark, SF_DIR).collect()  # start-up is not part of any query
    seconds = headline(spark)
    report = {
        "metric": "total seconds of the headline queries, fastest of repeats",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }
    if os.environ.get("BENCH_WORKLOAD", "1") != "0":
        report["published_workload"] = workload(spark, started + BUDGET)
    print(json.dumps(report), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
