"""How far the sources of a language differ in their words, for every pair of sources and for the words of each source.

Terms are counted once per (lang, source, term); a language keeps the terms of at least ``LEAST_DOCS`` of its documents.
A group, a source in its language or the language as a whole, gives a term that stands n times in it the share
``p = 1 + floor(SCALE * (n + 2) / (N + 2 * V))``: N is the sum of n over its V kept terms. Two shares differ by
``f(p, q) = floor((p - q)^2 / (p + q))``. All arithmetic is on integers and exact.

Summed over all kept terms, f of a pair of sources is ``V * f(0, 0)`` for terms that neither has, plus what each term
changes in it. A term that one source has n times changes it by ``f(n, 0) - f(0, 0)``, whatever the other source: those
changes come from a histogram of (source, n). Terms that both have need ``f(n, m) - f(n, 0) - f(0, m) + f(0, 0)`` more.
For these, every kept term is a row of its nonzero counts ordered by source. Equal rows are counted once with their
multiplicity and inserted into frequent-pattern trees. A node is one (source, n) below the counts of earlier sources,
terms with the same beginning share it, and each of its pairs with an ancestor is computed once, times the terms that
pass it. The changes are sums, so a tree may hold any part of the rows: rows are dealt out by range so that like
beginnings meet, a hot beginning is split over tasks, and a tree of ``NODES`` nodes hands on its sums and starts anew.

Null text, lang and source count as empty. Rows repeated count as often as they stand there. A group without kept terms
has no ``term`` rows and, with the other sources of its language, ``pair`` rows; a language with one source has no
``pair`` rows. Equal values are ordered by item. An empty table gives an empty one. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm import columns as C
from tributary.session import written_once

LEAST_DOCS = 10  # documents of a language that a kept term stands in
TOP = 10  # terms reported of a group
SCALE = 1_000_000_000
NODES = 200_000  # nodes of one tree
SENT = 20_000  # groups that are sent to every task; more are joined
SALTS = 32  # parts of a language's rows where its groups are joined

# Characters that stand between terms.
_BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share_of(n: Column, below: Column) -> Column:
    """``1 + floor(SCALE * (n + 2) / below)``; in 64 bits where that is enough, else in decimals."""
    wide = (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.when(n < 9_000_000_000, _div((n + 2) * F.lit(SCALE).cast("bigint"), below)).otherwise(_div(wide, below.cast("decimal(20,0)")))


def difference(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))``; shares are at most ``SCALE + 1``, so 64 bits hold it."""
    return _div((p - q) * (p - q), p + q)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences, and documents with the term. Summed in each task before the shuffle."""
    terms = F.sort_array(F.array_remove(F.split(C.ascii_lower(C.whole(text)), _BETWEEN), ""))

    def marked(found: Column) -> Column:
        return F.transform(found, lambda t, i: F.struct(t.alias("term"), (F.coalesce(t != F.get(found, i - 1), F.lit(True))).cast("int").alias("first")))

    each = docs.select(C.whole(lang).alias("lang"), C.whole(source).alias("source"), F.explode(C.let(terms, marked)).alias("t"))
    return each.groupBy("lang", "source", F.col("t.term").alias("term")).agg(F.count("*").alias("n"), F.sum("t.first").alias("docs"))


def kept_terms(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """``(lang, term, found)``: the counts of a kept term by source, in the order of sources; sources without it are not in it."""
    by_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("found"))
    return by_term.where(F.col("docs") >= least).select("lang", "term", "found")


def groups_of(docs: DataFrame, kept: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, terms, below, zero)`` of every group: V, N + 2 V, and the share of a term that it has not."""
    present = docs.select(C.whole(lang).alias("lang"), C.whole(source).alias("source")).distinct()
    totals = kept.select("lang", F.explode("found").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("total"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    all_of = present.join(totals, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["total", "terms"])
    below = F.col("total") + 2 * F.col("terms")
    return all_of.select(
        "lang", "source", "terms", below.alias("below"), F.when(below > 0, share_of(F.lit(0).cast("bigint"), below)).alias("zero")
    )


class _Tree:
    """A frequent-pattern tree of the rows of one language, as arrays by node."""

    def __init__(self):
        self.children: dict[tuple[int, int, int], int] = {}
        self.parent: list[int] = []
        self.source: list[int] = []
        self.shares: list[tuple[int, int]] = []
        self.times: list[int] = []

    def insert(self, sources: list[int], counts: list[int], shares: list[tuple[int, int]], times: int) -> None:
        node, children = -1, self.children
        for source, n, pair in zip(sources, counts, shares):
            below = children.get((node, source, n))
            if below is None:
                below = children[node, source, n] = len(self.parent)
                self.parent.append(node)
                self.source.append(source)
                self.shares.append(pair)
                self.times.append(0)
            self.times[below] += times
            node = below

    def changes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(source, source, change)``: the summed changes of every pair of sources that share a path."""
        parent, source, times = np.array(self.parent, np.int64), np.array(self.source, np.int64), np.array(self.times, np.int64)
        share = np.array(self.shares, np.int64).reshape(-1, 2)
        many = int(source.max(initial=0)) + 1
        nodes, above = np.flatnonzero(parent >= 0), parent[parent >= 0]
        codes, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(nodes):  # once for each distance between a node and an ancestor
            (p, p0), (q, q0) = share[nodes].T, share[above].T
            change = (_f(p, q) - _f(p, q0) - _f(p0, q) + _f(p0, q0)) * times[nodes]
            codes, place = np.unique(np.concatenate([codes, source[above] * many + source[nodes]]), return_inverse=True)
            total = np.zeros(len(codes), np.int64)
            np.add.at(total, place, np.concatenate([sums, change]))
            sums = total
            higher = parent[above]
            nodes, above = nodes[higher >= 0], higher[higher >= 0]
        return codes // many, codes % many, sums


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _tree_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(lang, path, times)``, sorted, to partial sums ``(lang, a, b, change)`` with a before b."""
    tree, lang, names, numbers = _Tree(), None, [], {}

    def told() -> pa.RecordBatch:
        a, b, change = tree.changes()
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(a), pa.string()), pa.array([names[i] for i in a], pa.string()), pa.array([names[i] for i in b], pa.string()), pa.array(change, pa.int64())],
            ["lang", "a", "b", "change"],
        )

    for batch in batches:
        langs, times = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        ends = batch.column(1).offsets.to_numpy().tolist()
        source, n, p, zero = (batch.column(1).values.field(i).to_pylist() for i in range(4))
        for row in range(batch.num_rows):
            if langs[row] != lang or len(tree.parent) >= NODES:
                if tree.parent:
                    yield told()
                tree, lang, names, numbers = _Tree(), langs[row], [], {}
            start, end = ends[row], ends[row + 1]
            codes = []
            for name in source[start:end]:
                code = numbers.get(name)
                if code is None:
                    code = numbers[name] = len(names)
                    names.append(name)
                codes.append(code)
            tree.insert(codes, n[start:end], list(zip(p[start:end], zero[start:end])), times[row])
    if tree.parent:
        yield told()


def shared_changes(entries: DataFrame) -> DataFrame:
    """``(lang, a, b, change)``: the changes by terms that both of two sources have; a is before b."""
    row = F.sort_array(F.collect_list(F.struct("source", "n", "p", "zero")))
    rows = entries.groupBy("lang", "term").agg(row.alias("path")).where(F.size("path") > 1)
    alike = rows.groupBy("lang", "path").agg(F.count("*").alias("times"))
    starts = [F.xxhash64(F.get("path", F.lit(i))) for i in range(4)]  # small keys for the ranges; the whole row breaks ties
    dealt = alike.repartitionByRange("lang", *starts, F.xxhash64("path")).sortWithinPartitions("lang", "path")
    found = dealt.select("lang", "path", "times").mapInArrow(_tree_changes, "lang string, a string, b string, change bigint")
    return found.groupBy("lang", "a", "b").agg(F.sum("change").alias("change"))


def _beside(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """Each row with every group of its language. Many groups are joined to parts of the language's rows."""
    if few:
        return rows.join(F.broadcast(groups), "lang")
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).alias("part")
    parts = groups.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return rows.select("*", part).join(parts, ["lang", "part"]).drop("part")


def pairs(entries: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """``(lang, source, item, value)`` for every ordered pair of sources of a language."""
    other = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("b_zero"))
    own = groups.select("lang", F.col("source").alias("a"), "zero", "terms")
    neither = _beside(own, other, few).where("a < b").select(
        "lang", "a", "b", F.when(F.col("terms") > 0, F.col("terms") * difference(F.col("zero"), F.col("b_zero"))).otherwise(F.lit(0)).alias("change")
    )
    seen = entries.groupBy("lang", F.col("source").alias("a"), "n", "p", "zero").agg(F.count("*").alias("times"))
    one = _beside(seen, other, few).where("a <> b").groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.sum(F.col("times") * (difference(F.col("p"), F.col("b_zero")) - difference(F.col("zero"), F.col("b_zero")))).alias("change")
    )
    each = neither.unionByName(one).unionByName(shared_changes(entries)).groupBy("lang", "a", "b").agg(F.sum("change").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return each.select("lang", both.alias("pair"), "value").select("lang", "pair.source", "pair.item", "value")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: ``pair`` rows for the other sources of the language, ``term`` rows for the
    terms that the source has more often than its language."""
    kept = written_once(kept_terms(term_counts(docs, text, lang, source), least))
    groups = written_once(groups_of(docs, kept, lang, source))
    few = groups.count() <= SENT
    known = groups.where("below > 0")
    known = F.broadcast(known) if few else known
    everywhere = F.aggregate("found", F.lit(0).cast("bigint"), lambda total, e: total + e["n"])
    cut = kept.select("lang", "term", everywhere.alias("in_lang"), F.explode("found").alias("e")).select("lang", "term", "in_lang", "e.source", "e.n")
    entries = cut.join(known, ["lang", "source"]).withColumn("p", share_of(F.col("n"), F.col("below")))
    langs = groups.groupBy("lang").agg((F.sum(F.col("below") - 2 * F.col("terms")) + 2 * F.max("terms")).alias("lang_below"))
    beside = entries.join(F.broadcast(langs) if few else langs, "lang").withColumn("q", share_of(F.col("in_lang"), F.col("lang_below")))
    terms = beside.where("p > q").select("lang", "source", F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    return _ranked(pairs(entries, groups, few), "pair").unionByName(_ranked(terms, "term").where(F.col("rank") <= top))
