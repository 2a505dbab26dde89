"""Running a stream over what has arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame


_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_into(found: DataFrame, path: str, checkpoint: str, idle_batches: bool = True) -> None:
    """Append what the stream has now to the table at ``path`` and stop; the next run goes on from ``checkpoint``.

    Batches without data close windows behind the watermark. A stream whose state times out by the clock never runs out
    of them, so it needs ``idle_batches=False``: its state times out when data come in.
    """
    conf = found.sparkSession.conf
    before = conf.get(_IDLE)
    conf.set(_IDLE, str(idle_batches).lower())
    try:
        writer = found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        query = writer.trigger(availableNow=True).start(path)
    finally:
        conf.set(_IDLE, before)
    query.awaitTermination()
