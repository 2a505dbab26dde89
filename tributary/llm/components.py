"""Connected components of a table of links.

Each task first contracts the links it holds with disjoint sets, a bounded number of them, so that at most one link a
node is left in it. Where that took more than one task, alternating large-star and small-star steps connect what the
tasks found: each is a grouping and a join on a node, links of a node are reduced to its smallest neighbour in every
task before the shuffle, and nothing is collected. What a step made is written to the shared folder, so a lost
executor costs one step. The number of steps grows with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.session import written_once

STEPS = 40
CONTRACTED = 500_000  # links that one task contracts


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``(u, v)`` of a task as one link from each node to the smallest node it is connected with here."""
    over: dict[int, int] = {}

    def of(x: int) -> int:
        while (y := over.setdefault(x, x)) != x:
            over[x] = over[y] = over.setdefault(y, y)
            x = over[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = of(u), of(v)
            over[max(a, b)] = min(a, b)
    nodes = np.fromiter(over, dtype="i8", count=len(over))
    roots = np.fromiter((of(x) for x in list(over)), dtype="i8", count=len(over))
    moved = nodes != roots
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(roots[moved])], ["u", "v"])


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours, linked to the smallest of node and neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours, linked to the smallest of them. ``links`` have ``u > v``."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, contracted: int = CONTRACTED) -> DataFrame:
    """``(u, v)`` links, equal ends aside, to ``(node, component)`` of every linked node; the component is its smallest node."""
    links = written_once(links.select("u", "v").where(F.col("u") != F.col("v")))
    tasks = max(1, -(-links.count() // contracted))
    links = written_once(links.coalesce(tasks).mapInArrow(_contract, "u bigint, v bigint"))
    before = None
    for _ in range(STEPS if tasks > 1 else 0):
        links = written_once(_small_star(_large_star(links).distinct()))
        now = _mark(links)
        if now == before:
            break
        before = now
    else:
        if tasks > 1:
            raise RuntimeError(f"links did not settle in {STEPS} steps")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
