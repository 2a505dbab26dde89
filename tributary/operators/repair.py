"""Repair of a replica of which nobody knows what it lacks: compare digests, then move what differs.

Both tables are hashed into buckets by key. A bucket's digest is an order-insensitive sum of row hashes, taken in each
task before one small shuffle. Rows are read again only from buckets whose digests differ, and only rows that
differ are sent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
_SALTS = (17, 71)  # two 64-bit hashes of a row


def _rest(rows: DataFrame, key: str) -> list[str]:
    return sorted(c for c in rows.columns if c != key)


def _hashes(rows: DataFrame, key: str) -> list[Column]:
    """Hashes of a whole row; which columns are null is hashed too, since a null alone changes no hash."""
    columns = [key, *_rest(rows, key)]
    nulls = [F.col(f"`{c}`").isNull() for c in columns]
    return [F.xxhash64(F.lit(salt), *[F.col(f"`{c}`") for c in columns], *nulls) for salt in _SALTS]


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(buckets)).cast("int")


def digests(rows: DataFrame, key: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n, a, b)``: rows of each bucket and the exclusive or of their hashes. Keys are unique."""
    a, b = _hashes(rows, key)
    return rows.groupBy(bucket_of(key, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(a).alias("a"), F.bit_xor(b).alias("b"))


def differing(master: DataFrame, replica: DataFrame, key: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """``(bucket)`` of the buckets whose rows are not the same on both sides; at most ``buckets`` rows."""
    theirs = digests(replica, key, buckets).select("bucket", F.struct("n", "a", "b").alias("theirs"))
    both = digests(master, key, buckets).select("bucket", F.struct("n", "a", "b").alias("ours")).join(theirs, "bucket", "full_outer")
    return both.where(~F.col("ours").eqNullSafe(F.col("theirs"))).select("bucket")


@dataclass
class Repair:
    """``sent`` has a row for each key that differs: the key, ``op`` (upsert or delete) and the master's columns.
    ``compared`` has the rows of both sides that were read for it."""

    sent: DataFrame
    compared: DataFrame


def repair(master: DataFrame, replica: DataFrame, key: str = "id", buckets: int = BUCKETS) -> Repair:
    """What the replica has to take over to equal the master."""
    wrong = F.broadcast(differing(master, replica, key, buckets))  # at most ``buckets`` numbers
    columns = _rest(master, key)

    def side(rows: DataFrame) -> DataFrame:
        a, b = _hashes(rows, key)
        placed = rows.withColumns({"_bucket": bucket_of(key, buckets), "_a": a, "_b": b})
        return placed.join(wrong, F.col("_bucket") == F.col("bucket"), "left_semi")

    ours, theirs = side(master), side(replica).select(key, F.col("_a").alias("_c"), F.col("_b").alias("_d"), F.lit(True).alias("_there"))
    ours = ours.withColumn("_here", F.lit(True))
    both = ours.join(theirs, key, "full_outer")
    same = F.coalesce((F.col("_a") == F.col("_c")) & (F.col("_b") == F.col("_d")), F.lit(False))
    op = F.when(F.col("_here").isNull(), "delete").otherwise("upsert").alias("op")
    sent = both.where(~same).select(key, op, *[F.col(f"`{c}`") for c in columns])
    compared = ours.agg(F.count(F.lit(1)).alias("ours")).crossJoin(theirs.agg(F.count(F.lit(1)).alias("theirs")))  # one row each
    return Repair(sent, compared)


def repaired(replica: DataFrame, sent: DataFrame, key: str = "id") -> DataFrame:
    """The replica after it took over what was sent."""
    kept = replica.join(sent.select(key), key, "left_anti")
    return kept.unionByName(sent.where("op = 'upsert'").select(*replica.columns))
