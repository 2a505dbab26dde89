"""Run results as rows, and timed runs that produce them."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary import schemas
from tributary.operators import changes, knn, stats


def save(spark: SparkSession, path: str, run_id: str, name: str, metrics: dict[str, float]) -> None:
    """Append the metrics of one named result under its run."""
    rows = [(run_id, name, metric, float(value)) for metric, value in metrics.items()]
    df = spark.createDataFrame(rows, "run_id string, name string, metric string, value double")
    stamped = df.withColumn("run_ts", F.current_timestamp())
    schemas.conform(stamped, schemas.RUN_RESULT).write.mode("append").partitionBy("run_id").parquet(path)


def load(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    rows = spark.read.schema(schemas.RUN_RESULT).parquet(path)
    return rows if run_id is None else rows.filter(F.col("run_id") == run_id)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest value of every metric."""
    return load(spark, path).groupBy("name", "metric").agg(
        F.max_by("value", "run_ts").alias("value"), F.max_by("run_id", "run_ts").alias("run_id")
    )


def timed(action: Callable[[], object], repeats: int = 3) -> float:
    """Seconds of the fastest of ``repeats`` runs."""
    best = float("inf")
    for _ in range(repeats):
        start = time.monotonic()
        action()
        best = min(best, time.monotonic() - start)
    return best


def run_to_end(df: DataFrame) -> None:
    """Compute every row and column of ``df`` and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def capture_cost(spark: SparkSession, rows: DataFrame, key: str, folder: str, repeats: int = 1) -> DataFrame:
    """Load ``rows`` without capture, with full images and with shadow rows; ``schemas.CAPTURE_METRICS``.

    A way of capture that fails is reported with its error instead of figures.
    """
    n = rows.count()
    image = F.to_json(F.struct(*rows.columns))
    full = rows.select(
        F.monotonically_increasing_id().alias("change_id"),
        F.lit(1).alias("change_type"),
        F.lit("rows").alias("table_name"),
        F.lit(None).cast("string").alias("before"),
        image.alias("after"),
    )
    ways = {"none": None, "full": full, "shadow": changes.capture_inserts(rows, 0)}
    reports = []
    for name, captured in ways.items():
        place = f"{folder}/{name}"

        def load(place=place, captured=captured) -> None:
            rows.write.mode("overwrite").parquet(f"{place}/rows")
            if captured is not None:
                captured.write.mode("overwrite").parquet(f"{place}/log")

        try:
            seconds = timed(load, repeats)
            size = stats.footprint(spark, place).first()["bytes"]
            seen = 0 if captured is None else spark.read.parquet(f"{place}/log").count()
            reports.append((name, n, seconds, n / seconds, seen, None, size, None))
        except Exception as failure:  # this way of capture does not work here: report it and go on
            reports.append((name, n, None, None, None, None, None, f"unsupported: {failure}"))
    return spark.createDataFrame(reports, schemas.CAPTURE_METRICS)


def search_curve(corpus: DataFrame, queries: DataFrame, sizes: Sequence[int], k: int = 10, repeats: int = 3) -> list[dict]:
    """Seconds for all queries over growing corpora; ``sizes`` are counts of rows by id order."""
    curve = []
    for size in sizes:
        last = corpus.select("id").orderBy("id").limit(size).agg(F.max("id")).first()[0]
        part = corpus.filter(F.col("id") <= last)
        seconds = timed(lambda part=part: run_to_end(knn.nearest(part, queries, k)), repeats)
        curve.append({"rows": size, "seconds": round(seconds, 3)})
    return curve
