"""Line dedup by the spread of a line over sites.

Every line of every text is hashed. For each hash a HyperLogLog sketch of the sites it stands on is built in each task
and merged by aggregation; lines whose estimate is clearly at or above ``sites`` are boilerplate, lines near it are
counted again, exactly. Boilerplate lines are removed from every text but the first that has them (by id, then
place), so nothing is lost from the corpus. Line breaks around what stays are kept.

Only hashes, sites and places are shuffled to find lines, summed in each task first; a line that stands everywhere is
one small sketch per task. The boilerplate table grows with the corpus, so it is joined, by hash, and not sent around.

Lines are compared without the white space around them; lines without a word never count. A null site is a site of its
own. Null texts count as empty and stay as they are. Null ids count as an id, before all others. Rows alike in id and
text are one text, each gets the same lines removed. Each input row gives one output row; further columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm import columns as C
from tributary.session import written_once

SITES = 5
MARGIN = 0.25  # estimates within this share of the bound are counted exactly
SKETCH = 10  # logarithm of a sketch's registers; its error is about 3 per cent


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(C.SPACES))


def lines(docs: DataFrame, key: str, text: str, site: str) -> DataFrame:
    """``(id, row, at, hash, site)`` of every line with a word."""
    rows = docs.select(
        F.col(key).alias("id"),
        F.xxhash64(text).alias("row"),
        F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
        F.posexplode(F.split(C.whole(text), "\n")).alias("at", "line"),
    )
    rows = rows.select("id", "row", "site", "at", _bare(F.col("line")).alias("line")).where("line <> ''")
    return rows.select("id", "row", "at", F.xxhash64("line").alias("hash"), "site")


def boilerplate(found: DataFrame, sites: int = SITES, margin: float = MARGIN) -> DataFrame:
    """``(hash, first)``: lines that stand on ``sites`` sites or more, and the id, row and place of the first."""
    place = F.struct("id", "row", "at")
    spread = found.groupBy("hash").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH))).alias("spread"), F.min(place).alias("first")
    )
    spread = written_once(spread.where(F.col("spread") >= sites * (1 - margin)))
    sure = spread.where(F.col("spread") > sites * (1 + margin)).select("hash", "first")
    near = spread.where(F.col("spread") <= sites * (1 + margin))
    exact = found.select("hash", "site").join(near.select("hash"), "hash", "left_semi").distinct()
    exact = exact.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= sites)
    return sure.unionByName(near.join(exact, "hash").select("hash", "first"))


def removed_lines(docs: DataFrame, sites: int = SITES, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """``(id, row, gone)``: for each text that loses lines, their places."""
    found = lines(docs, key, text, site)
    known = written_once(boilerplate(found, sites))
    here = found.select("id", "row", "at", "hash").join(known, "hash")
    later = ~F.struct("id", "row", "at").eqNullSafe(F.col("first"))
    return here.where(later).groupBy("id", "row").agg(F.collect_set("at").alias("gone"))


def without_boilerplate(docs: DataFrame, sites: int = SITES, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """``docs`` with the boilerplate taken out of ``text``, and two columns more: ``lines_in`` and ``lines_removed``."""
    gone = removed_lines(docs, sites, key, text, site).select(F.col("id").alias("__id"), F.col("row").alias("__row"), F.col("gone").alias("__gone"))
    joined = docs.join(gone, F.col(key).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__row")), "left")
    cut = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("__gone", i))
    changed = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(cut, "\n"))
    return joined.select(
        *[changed.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
        F.size(F.split(C.whole(text), "\n")).cast("bigint").alias("lines_in"),
        F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("bigint").alias("lines_removed"),
    )
