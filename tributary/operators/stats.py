"""Latency, rate, overhead and size reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.functions import scalars
from tributary.session import written_once

ACCURACY = 10_000


def _brackets(rows: DataFrame, shares: Sequence[float], accuracy: int) -> DataFrame:
    """``(_g, n, mean, share, low, high, target)``: where the wanted ranks of ``rows(_g, _v)`` must lie."""
    slack = 2.0 / accuracy
    cuts = [min(max(s + side * slack, 0.0), 1.0) for s in shares for side in (-1, 1)]
    sketch = rows.groupBy("_g").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_v").alias("mean"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", cuts, accuracy).alias("_cuts"),
    )
    brackets = []
    for i, share in enumerate(shares):
        low = F.col("_min") if share <= slack else F.element_at("_cuts", 2 * i + 1)
        high = F.col("_max") if share >= 1 - slack else F.element_at("_cuts", 2 * i + 2)
        target = F.least(F.floor(F.col("n") * F.lit(float(share))), F.col("n") - 1)
        brackets.append(
            F.struct(F.lit(float(share)).alias("share"), low.alias("low"), high.alias("high"), target.alias("target"))
        )
    return sketch.select("_g", "n", "mean", F.explode(F.array(*brackets)).alias("w")).select("_g", "n", "mean", "w.*")


def order_statistics(
    df: DataFrame, group: str, value: str, shares: Sequence[float], accuracy: int = ACCURACY
) -> DataFrame:
    """Exact sorted values ``t[floor(share * n)]`` per group as ``(group, share, n, mean, value)``.

    No group is sorted whole. A sketch brackets each wanted rank within ``n / accuracy`` ranks; then
    rows below the bracket are counted and only the distinct values inside it are ranked. That is two
    passes over ``df``.
    """
    rows = df.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull()
    )
    wanted = written_once(_brackets(rows, shares, accuracy))
    # Each task turns its rows into one count for all that lies below a bracket and one per distinct
    # value inside it; only those counts are shuffled.
    placed = rows.join(wanted, "_g").filter(F.col("_v") <= F.col("high"))
    step = F.when(F.col("_v") >= F.col("low"), F.col("_v"))
    by = ["_g", "share", "n", "mean", "target"]
    steps = placed.groupBy(*by, step.alias("_step")).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy("_g", "share").orderBy(F.asc_nulls_first("_step")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    inside = F.col("_step").isNotNull()
    found = (
        steps.withColumn("_upto", F.sum("_c").over(upto))
        .groupBy(*by)
        .agg(
            F.min(F.when(inside & (F.col("_upto") > F.col("target")), F.col("_step"))).alias("_at"),
            F.coalesce(F.max(F.when(~inside, F.col("_upto"))), F.lit(0)).alias("_below"),
        )
    )
    bracketed = (F.col("_below") <= F.col("target")) & F.col("_at").isNotNull()
    checked = F.when(bracketed, F.col("_at")).otherwise(
        F.raise_error(F.lit("rank lies outside its bracket; raise the accuracy")).cast("double")
    )
    return found.select(F.col("_g").alias(group), "share", "n", "mean", checked.alias(value))


def latency_summary(
    samples: DataFrame, group: str = "query", seconds: str = "seconds", places: int = 2, scale: float = 1000.0
) -> DataFrame:
    """p50, p95 and mean per group, scaled (seconds to ms) and rounded."""
    p50, p95 = 0.5, 0.95

    def shown(value: Column) -> Column:
        return F.round(value * scale, places)

    def at(share: float) -> Column:
        return F.max(F.when(F.col("share") == share, F.col(seconds)))

    return (
        order_statistics(samples, group, seconds, [p50, p95])
        .groupBy(group, "n", "mean")
        .agg(shown(at(p50)).alias("p50_ms"), shown(at(p95)).alias("p95_ms"))
        .select(group, "n", "p50_ms", "p95_ms", shown(F.col("mean")).alias("mean_ms"))
    )


SKETCH_K = 200  # accuracy of the sketches below
RANK_ERROR = 0.0266  # twice the rank error that a sketch of this size keeps with 99 % confidence


def add_sketches(samples: DataFrame, path: str, version: str, group: str, value: str) -> None:
    """Append one quantile sketch per version and group to the table at ``path``; only these samples are read.

    The version is a column like others: a folder for each would be a file per version and task.
    """
    sketch = F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH_K).alias("sketch")
    samples.groupBy(version, group).agg(sketch).write.mode("append").parquet(path)


def merged_sketches(stored: DataFrame, group: str) -> DataFrame:
    """``(group, sketch)`` over the versions in ``stored``: sketches are merged, samples are not read again."""
    return stored.groupBy(group).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_percentiles(merged: DataFrame, group: str, shares: Sequence[float]) -> DataFrame:
    """``(group, share, value)`` from sketches."""
    told = [F.struct(F.lit(float(s)).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))).alias("value")) for s in shares]
    return merged.select(group, F.explode(F.array(*told)).alias("e")).select(group, "e.share", "e.value")


def within_bounds(merged: DataFrame, samples: DataFrame, group: str, value: str, shares: Sequence[float]) -> DataFrame:
    """``(group, share, n, within)``: whether the sketched percentiles have ranks within the error, by one count over all samples."""
    told = sketched_percentiles(merged, group, shares).select(group, "share", F.col("value").alias("_at"))
    ranks = samples.select(group, F.col(value).alias("_v")).join(F.broadcast(told), group).groupBy(group, "share").agg(  # one row a group and share
        F.count("_v").alias("n"), F.count(F.when(F.col("_v") < F.col("_at"), 1)).alias("_below"), F.count(F.when(F.col("_v") <= F.col("_at"), 1)).alias("_upto")
    )
    low, high = F.col("_below") / F.col("n") - RANK_ERROR, F.col("_upto") / F.col("n") + RANK_ERROR
    return ranks.select(group, "share", "n", F.col("share").between(low, high).alias("within"))


def best_of(runs: DataFrame, query: str = "query", seconds: str = "seconds") -> DataFrame:
    return runs.groupBy(query).agg(F.min(seconds).alias("best"), F.count(F.lit(1)).alias("repeats"))


def capture_overhead(runs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """``runs(mode 'off'|'on', rate, bytes)`` → throughput lost (%) and storage growth (x)."""
    def of(mode: str, column: str) -> Column:
        return F.max(F.when(F.col("mode") == mode, F.col(column)))

    sides = runs.groupBy(*group).agg(
        of("off", "rate").alias("off_rate"),
        of("on", "rate").alias("on_rate"),
        of("off", "bytes").alias("off_bytes"),
        of("on", "bytes").alias("on_bytes"),
    )
    return sides.select(
        *group,
        F.round(scalars.overhead_pct(F.col("off_rate"), F.col("on_rate")), 1).alias("throughput_overhead_pct"),
        F.round(scalars.amplification(F.col("off_bytes"), F.col("on_bytes")), 2).alias("storage_amplification_x"),
        F.round(scalars.ratio(F.col("off_rate"), F.col("on_rate")), 1).alias("slower_x"),
    )


def _seconds(span: Column) -> Column:
    """Length of a day-to-second interval; unlike a difference of instants it knows no time zone."""
    whole = sum(F.extract(F.lit(unit), span) * n for unit, n in (("DAY", 86_400), ("HOUR", 3600), ("MINUTE", 60)))
    micros = (F.extract(F.lit("SECOND"), span) * 1_000_000).cast("bigint")
    return (whole.cast("bigint") * 1_000_000 + micros) / F.lit(1e6)


def docs_per_minute(events: DataFrame, ts: str = "ts", group: Sequence[str] = ()) -> DataFrame:
    """Rows per minute over the window the rows span; 0 for a window without length."""
    spans = events.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        _seconds(F.max(ts) - F.min(ts)).alias("event_window_s"),
    )
    return spans.withColumn(
        "docs_per_min",
        F.when(F.col("event_window_s") > 0, F.col("n") / F.col("event_window_s") * 60.0).otherwise(F.lit(0.0)),
    )


def rate_per_window(events: DataFrame, ts: str = "ts", width: str = "1 minute", late: str | None = None) -> DataFrame:
    """Rows per time window. With ``late`` the input may be a stream, and windows close behind the watermark."""
    if late is not None:  # a watermark needs an instant; a time without zone is read in the session's zone
        events = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return events.groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n"
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(name, c)`` for each table; Parquet tables are counted from their footers' row groups."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("c")).select(F.lit(name).alias("name"), "c") for name, df in tables.items()
    ]
    whole = counted[0]
    for one in counted[1:]:
        whole = whole.unionByName(one)
    return whole


def footprint(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes under ``path``; file contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    )
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def recall(found: DataFrame, truth: DataFrame, k: int, query: str = "query_id", item: str = "id") -> DataFrame:
    """Mean share of the true top-k that was found, as ``(queries, recall)``."""
    hits = (
        truth.select(query, item)
        .join(found.select(query, item).withColumn("_hit", F.lit(1)), [query, item], "left")
        .groupBy(query)
        .agg((F.coalesce(F.sum("_hit"), F.lit(0)) / F.lit(float(k))).alias("share"))
    )
    return hits.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("share"), 3).alias("recall"))
