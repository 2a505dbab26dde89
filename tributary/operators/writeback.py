"""Write-back: an outbox per source, flushed in order, landed idempotently in one inbox."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions import records, scalars
from tributary.operators import changes

PAGE = 1000  # fixed value: most rows one source flushes at a time


def pending(outbox: DataFrame, acks: DataFrame) -> DataFrame:
    """Outbox rows not acknowledged yet."""
    return outbox.join(acks, ["src", "seq"], "left_anti")


def next_page(waiting: DataFrame, size: int = PAGE) -> DataFrame:
    """The oldest ``size`` waiting rows of each source; the rest waits for the next flush."""
    oldest = Window.partitionBy("src").orderBy("seq")
    return waiting.withColumn("_n", F.row_number().over(oldest)).filter(F.col("_n") <= size).drop("_n")


def message(rows: DataFrame) -> DataFrame:
    """``(id, src, seq, payload)``: id from source and number; a payload that is not JSON becomes a JSON string."""
    return rows.select(
        scalars.writeback_id(F.col("src"), F.col("seq")).alias("id"),
        "src",
        "seq",
        records.json_or_string(F.col("payload")).alias("payload"),
    )


def delivered_prefix(page: DataFrame, ok: Column) -> DataFrame:
    """Rows of ``page`` before the first one of their source that was not delivered."""
    failed = F.min(F.when(~ok, F.col("seq"))).over(Window.partitionBy("src"))
    return page.withColumn("_failed", failed).filter(
        F.col("_failed").isNull() | (F.col("seq") < F.col("_failed"))
    ).drop("_failed")


def deliver(page: DataFrame, send: Callable[[dict], bool]) -> DataFrame:
    """Send a page in order, source by source, stopping a source at its first failure: ``(src, seq)`` sent.

    ``send`` gets ``{id, src, payload}``. A task that is run again sends again, which the inbox absorbs
    because ids repeat. A group is one source's page, so it is bounded.
    """

    def in_order(rows: pd.DataFrame) -> pd.DataFrame:
        sent = []
        for row in rows.sort_values("seq").to_dict("records"):
            try:
                if not send({"id": row["id"], "src": row["src"], "payload": row["payload"]}):
                    break
            except Exception:  # a refused delivery stays queued, whatever the reason
                break
            sent.append((row["src"], row["seq"]))
        return pd.DataFrame(sent, columns=["src", "seq"])

    sent_type = f"src string, seq {page.schema['seq'].dataType.simpleString()}"
    return message(page).groupBy("src").applyInPandas(in_order, sent_type)


def landed(messages: DataFrame, order: str = "seq") -> DataFrame:
    """The last message per id; a redelivered message is one row."""
    return changes.fold(messages, "id", order)
