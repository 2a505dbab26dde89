"""The fold of a change stream with late and repeated changes, kept in the stream's state.

The state of a key is the number of its last change and whether that was a delete. A change that is not newer is
dropped, so repeats and late arrivals have no effect; whatever passes is newer than all before it. Each task first cuts its rows to
the last one per key, so a key with a large share of a micro-batch is a few rows when it is shuffled. Keys are kept in
buckets by their hash, and a micro-batch calls Python once a bucket: a call per key costs far more than its few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tributary.operators import changes

BUCKETS = 4096  # of keys; a micro-batch reads and writes the state of the buckets it touches
STATE = "keys array<string>, last array<bigint>, deleted array<boolean>, seen array<bigint>"


def _last_rows(key: str, order: str):
    """A ``mapInArrow`` function: the last row of each key by ``order`` in every batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            frame = pd.DataFrame({"key": batch.column(key).to_pandas(), "order": batch.column(order).to_pandas()})
            last = frame.sort_values("order", kind="stable").drop_duplicates("key", keep="last").index
            yield batch.take(pa.array(sorted(last)))

    return run


def newest_changes(
    stream: DataFrame, key: str = "id", order: str = "change_id", remember_ms: int | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """The changes of ``stream(key, order, op, ...)`` that are newer than all of their key before.

    Append mode. Of a micro-batch only the last change per key comes out. With ``remember_ms`` a key that saw no change
    for so long is forgotten, tombstones too: a change later than that counts as new. Without it keys are kept for good.
    The number of ``buckets`` belongs to the checkpoint; many millions of keys want more of them.
    """
    columns = stream.columns
    schema = stream.schema
    timeout = GroupStateTimeout.NoTimeout if remember_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        known = {k: (n, gone, seen) for k, n, gone, seen in zip(*state.get)} if state.exists else {}
        if remember_ms is not None:
            known = {k: told for k, told in known.items() if now - told[2] <= remember_ms}
        frames, place = [], {}
        for part in parts:
            for row, (k, n, op) in enumerate(zip(part["_key"].tolist(), part[order].tolist(), part["op"].tolist())):
                last = known.get(k)
                if last is None or n > last[0]:
                    known[k] = (int(n), op == "delete", now)
                    place[k] = (len(frames), row)
                else:
                    known[k] = (*last[:2], now)
            frames.append(part)
        state.update(([*known], *([told[i] for told in known.values()] for i in range(3))))
        if remember_ms is not None:
            state.setTimeoutDuration(remember_ms)
        for number, part in enumerate(frames):
            newest = [row for at, row in place.values() if at == number]
            if newest:
                yield part.iloc[newest][columns]

    cut = stream.mapInArrow(_last_rows(key, order), schema).withColumn("_key", F.col(key).cast("string"))
    bucketed = cut.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)))
    return bucketed.groupBy("_bucket").applyInPandasWithState(step, schema, STATE, "append", timeout)


def folded(written: DataFrame, key: str = "id", order: str = "change_id") -> DataFrame:
    """The last change per key of what the stream wrote: one row per key and micro-batch at most goes in."""
    return changes.fold(written, key, order)
