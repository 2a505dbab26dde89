"""Near duplicates by a chosen-path set similarity join.

A document is the set of its 5-word shingles. Documents with equal sets are one class from the start. Each class has
64 minwise tokens; a tree sends it down the paths of the tokens that its nodes choose: a node picks two coordinates by
a hash of its path, and classes that agree on one go to the same child, so similar classes stay together while nodes
shrink. Small nodes are compared exhaustively on signatures; in a larger one the classes close to a member drawn by hash
are linked to it and leave, and the rest goes on. Independent trees repeat this to the wanted recall: a pair of similarity
0.85 stays together in one tree with a chance of about 0.97, and is missed by four of them about once in a million. The
least similarity is an argument; agreeing tokens asked for and number of trees follow it, so a pair of similarity 0.80
meets in five trees to the same recall.

The trees only gather candidates into clusters. Within each cluster links are confirmed on the full sets: small
clusters pair by pair, skipping pairs that are connected already. A large cluster is first compared with its most
central member, one comparison each, and what is left with a next centre as long as that links half of it. If few
classes stand apart from the first centre, they are compared with all others, in blocks of bounded size. If many do,
each set is ordered from the rarest shingle of its cluster to the commonest: two sets at the bound share one of their
first shingles, whatever the order, and what a family of pages has in common stands last. Only pairs that share such a
shingle, at places from which the bound can still be reached, are compared. No step pairs up a whole group, and no
group meets in one task.

``component_id`` is the smallest id that can be reached over links. Null texts count as empty; texts without words have
no shingles and no links. Fewer than five words make one shingle. Rows with a null id are not linked and kept. Rows
that share an id are one document with several texts; rows repeated exactly stay or go together. Each input row gives
one output row; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm import columns as C
from tributary.llm.components import components
from tributary.session import written_once

WORDS = 5
LEAST = 85  # per cent of the union that a link must share
TOKENS = 64
DEPTH = 8
LEAF = 1024  # classes compared exhaustively on signatures
GROUP = 256  # classes compared exhaustively on full sets
BUCKETS = 1 << 16  # counts of shingles by which a large cluster's are ordered
SLICE = 2048  # classes of a cluster that are ordered by one copy of its counts
BLOCK = 4096  # classes that share a shingle and are paired in one piece
MISSED = 1e-6  # of the pairs at the bound

_U = np.uint64


def alike_from(least: int) -> int:
    """Agreeing tokens that make a candidate: 5.7 deviations below what a pair at ``least`` per cent has on average."""
    share = least / 100
    return int(TOKENS * share - 5.7 * math.sqrt(TOKENS * share * (1 - share)))


def leaves_from(least: int) -> int:
    """Agreeing tokens with a node's drawn member from which a class leaves the node: what is similar to the class agrees
    with the drawn member at ``alike_from`` tokens, too."""
    return int(100 * alike_from(least) / least)


def trees_for(least: int) -> int:
    """Trees that miss a pair at ``least`` per cent, all of them, at a rate of ``MISSED``; one level parts it at the square of its difference."""
    share = least / 100
    return max(1, math.ceil(math.log(MISSED) / math.log(4 / 3 * (1 - share) ** 2))) if least < 100 else 1


LIKE, CLOSE, TREES = alike_from(LEAST), leaves_from(LEAST), trees_for(LEAST)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text, from its word hashes."""
    n = len(words)
    if n == 0:
        return np.zeros(0, "<u8")
    size = min(size, n)
    total = np.full(n - size + 1, size, dtype="u8")
    for i in range(size):
        total = _mixed(total * _U(0x9E3779B97F4A7C15) + words[i : n - size + 1 + i])
    return np.unique(total)


class Minwise:
    """The smallest value of a set under each of ``TOKENS`` hash functions."""

    def __init__(self, tokens: int = TOKENS):
        rng = np.random.default_rng(10)
        self.a = rng.integers(0, 2**64, tokens, dtype="u8") | _U(1)
        self.b = rng.integers(0, 2**64, tokens, dtype="u8")

    def __call__(self, found: np.ndarray, stretch: int = 8192) -> np.ndarray:
        least = np.full(len(self.a), _U(2**64 - 1))
        for start in range(0, len(found), stretch):
            part = found[start : start + stretch]
            least = np.minimum(least, (self.a[:, None] * part[None, :] + self.b[:, None]).min(axis=1))
        return (least >> _U(32)).astype("u4")


def _word_hashes(text: Column) -> Column:
    return F.transform(C.words(C.ascii_lower(C.whole(text))), lambda w: F.xxhash64(w))


def _sets(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    lists = batch.column(column)
    values, ends = lists.values.to_numpy(zero_copy_only=False).view("u8"), lists.offsets.to_numpy()
    for start, end in zip(ends[:-1], ends[1:]):
        yield shingles(values[start:end])


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(id, n_shingles, k1, k2, tokens, bits)`` of every row: size and 128-bit key of its set, minwise tokens and one byte of each."""
    rows = docs.select(F.col(key).alias("id"), _word_hashes(F.col(text)).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minwise = Minwise()
        for batch in batches:
            n, k1, k2, tokens = [], [], [], []
            for found in _sets(batch, 1):
                n.append(len(found))
                with np.errstate(over="ignore"):
                    k1.append(_mixed(found).sum(dtype="u8"))
                    k2.append(_mixed(found ^ _U(0x5851F42D4C957F2D)).sum(dtype="u8"))
                tokens.append(minwise(found))
            block = np.array(tokens, dtype="u4").reshape(len(n), TOKENS)
            ends = pa.array(np.arange(len(n) + 1, dtype="i4") * TOKENS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(k1, "u8").view("i8")),
                    pa.array(np.array(k2, "u8").view("i8")),
                    pa.ListArray.from_arrays(ends, pa.array(block.view("i4").ravel())),
                    pa.array([row.tobytes() for row in (block & 0xFF).astype("u1")], pa.binary()),
                ],
                ["id", "n_shingles", "k1", "k2", "tokens", "bits"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_shingles bigint, k1 bigint, k2 bigint, tokens array<int>, bits binary")


def _children(rows: DataFrame, depth: int) -> DataFrame:
    """``(tree, node, c, bits)`` one level down; ``rows`` have ``(tree, node, c, tokens, bits)``.

    Each depth of each tree has eight coordinates of its own, of which a node takes two.
    """
    turn = F.lit(depth) + 2 * F.col("tree") + F.floor(F.col("tree") / 4).cast("int")
    base = F.pmod(turn * 8, F.lit(TOKENS))
    first = F.pmod(F.xxhash64("tree", "node"), F.lit(8))
    second = F.pmod(first + 1 + F.pmod(F.xxhash64("node", "tree", F.lit(1)), F.lit(7)), F.lit(8))
    sent = rows.select("tree", "node", "c", "tokens", "bits", F.explode(F.array(base + first, base + second)).alias("i"))
    child = F.xxhash64("tree", "node", "i", F.get("tokens", F.col("i").cast("int")))
    return sent.select("tree", child.alias("node"), "c", "bits")


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(axis=1)


def _bytes(column: pa.Array, width: int = TOKENS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "u1").reshape(len(column), width)


class _Sets:
    """Disjoint sets of the numbers below n."""

    def __init__(self, n: int):
        self.over = list(range(n))

    def of(self, i: int) -> int:
        over = self.over
        while over[i] != i:
            over[i] = over[over[i]]
            i = over[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.of(i), self.of(j)
        self.over[max(i, j)] = min(i, j)
        return i != j


def _runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows as tables that hold each run of equal keys (the first ``keys`` columns) whole; the input is sorted by them."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        end = tuple(c[-1] for c in columns)
        same = np.logical_and.reduce([c == e for c, e in zip(columns, end)])
        begin = int(np.argmax(same))  # the last run of the batch may go on
        if begin == 0 and end == last:
            kept.append(batch)
            continue
        if begin or kept:
            whole = [*kept, batch.slice(0, begin)]
            if sum(b.num_rows for b in whole):
                yield pa.Table.from_batches(whole).combine_chunks()
        kept, last = [batch.slice(begin)], end
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def _bounds(table: pa.Table, keys: int) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for i in range(keys):
        c = table.column(i).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def _leaf_links(batches: Iterator[pa.RecordBatch], like: int) -> Iterator[pa.RecordBatch]:
    """Links that connect the like classes of each small node; columns ``node, c, bits``."""
    for table in _runs(batches, 1):
        bounds = _bounds(table, 1)
        c = table.column(1).to_numpy()
        bits = _bytes(table.column(2).combine_chunks())
        sizes = np.diff(bounds)
        left = np.repeat(bounds[1:], sizes) - np.arange(len(c)) - 1  # members behind a row in its node
        sets, u, v = _Sets(len(c)), [], []
        for step in range(1, int(sizes.max())):
            at = np.flatnonzero(left >= step)
            for i in at[_agreeing(bits[at], bits[at + step]) >= like].tolist():
                if sets.join(i, i + step):
                    u.append(c[i])
                    v.append(c[i + step])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``agree``, the agreeing tokens of ``bits`` and ``pivot_bits``, the last column of the input."""
    for batch in batches:
        agree = _agreeing(_bytes(batch.column(5)), _bytes(batch.column(6)))
        names = ["tree", "node", "c", "n", "pivot", "bits", "agree"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(agree.astype("i4"))], names)


def candidate_links(classes: DataFrame, least: int = LEAST, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """``(u, v)`` links that gather like classes, those of similarity ``least`` per cent and more; ``classes`` has ``(c, tokens, bits)`` and is read several times.

    Each level is one grouping and one join on the node, written once; nodes of one class end there.
    """
    like, leaves = alike_from(least), leaves_from(least)

    def leaf_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _leaf_links(batches, like)

    roots = F.explode(F.array(*[F.lit(t) for t in range(trees_for(least))])).alias("tree")
    going = classes.select(roots, F.lit(0).cast("bigint").alias("node"), "c", "tokens", "bits")
    links = []
    for level in range(depth):
        rows = _children(going, level)
        sizes = rows.groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), F.min_by(F.struct("c", "bits"), F.xxhash64("tree", "c")).alias("first")
        ).select("node", "n", F.col("first.c").alias("pivot"), F.col("first.bits").alias("pivot_bits"))
        known = rows.join(sizes.where("n > 1"), "node").select("tree", "node", "c", "n", "pivot", "bits", "pivot_bits")
        known = written_once(known.mapInArrow(_close, "tree int, node bigint, c bigint, n bigint, pivot bigint, bits binary, agree int"))
        small = known.where(F.col("n") <= leaf).select("node", "c", "bits")
        links.append(small.repartition("node").sortWithinPartitions("node", "c").mapInArrow(leaf_links, "u bigint, v bigint"))
        # At the last level what is left of a node stays together.
        together = F.col("agree") >= (like if level < depth - 1 else 0)
        near = known.where((F.col("n") > leaf) & together & (F.col("c") != F.col("pivot")))
        links.append(near.select(F.col("pivot").alias("u"), F.col("c").alias("v")))
        rest = known.where((F.col("n") > leaf) & (F.col("agree") < leaves)).select("tree", "node", "c", "bits")
        if rest.isEmpty():
            break
        going = rest.join(classes.select("c", "tokens"), "c")
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    return found


def _linked(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    """Whether two sets share ``least`` per cent of their union."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < least * large:
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= least * (len(a) + len(b) - both)


def _as_set(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), "<u8")


def _exact_groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """``(u, v)`` confirmed links that connect each cluster's classes; columns ``cluster, c, set``."""
    for table in _runs(batches, 1):
        bounds, c = _bounds(table, 1), table.column(1).to_numpy()
        sets, u, v = table.column(2), [], []
        for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            found = [_as_set(sets[i]) for i in range(begin, end)]
            united = _Sets(len(found))
            for i in range(len(found)):
                for j in range(i + 1, len(found)):
                    if united.of(i) != united.of(j) and _linked(found[i], found[j], least):
                        united.join(i, j)
                        u.append(c[begin + i])
                        v.append(c[begin + j])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _exact_blocks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Confirmed links of a block of unlinked classes with a block of all; columns ``cluster, block, other, side, c, linked, bits, set``.

    Classes linked with the centre are connected already.
    """
    like = alike_from(least)
    for table in _runs(batches, 3):
        bounds, c = _bounds(table, 3), table.column(4).to_numpy()
        side, centred, sets = table.column(3).to_numpy(), table.column(5).to_numpy(), table.column(7)
        bits = _bytes(table.column(6).combine_chunks())
        u, v = [], []
        for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            here = np.arange(begin, end)
            ours, others = here[side[begin:end] == 0], here[side[begin:end] == 1]
            names = {x: i for i, x in enumerate(dict.fromkeys([-1, *c[here].tolist()]))}
            united = _Sets(len(names))
            place = {i: 0 if centred[i] else names[c[i]] for i in here.tolist()}
            for i in ours.tolist():
                for j in others[_agreeing(bits[others], bits[i][None, :]) >= like].tolist():
                    if united.of(place[i]) != united.of(place[j]) and _linked(_as_set(sets[i]), _as_set(sets[j]), least):
                        united.join(place[i], place[j])
                        u.append(c[i])
                        v.append(c[j])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _to_centre(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Columns ``cluster, c, centre, set, centre_set`` to ``cluster, c, centre, linked``."""
    for batch in batches:
        linked = [_linked(_as_set(a), _as_set(b), least) for a, b in zip(batch.column(3), batch.column(4))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(linked, pa.bool_())], ["cluster", "c", "centre", "linked"])


def _centres(members: DataFrame) -> DataFrame:
    """``(cluster, centre)``: the class that agrees with the cluster's commonest token at most coordinates."""
    each = members.select("cluster", F.posexplode("tokens").alias("i", "token"))
    common = each.groupBy("cluster", "i", "token").agg(F.count(F.lit(1)).alias("n"))
    common = common.groupBy("cluster", "i").agg(F.max_by("token", F.struct("n", "token")).alias("token"))
    ideal = common.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("i", "token"))).alias("ideal"))  # 64 of each
    told = members.select("cluster", "c", "tokens").join(ideal, "cluster")
    agree = F.size(F.filter(F.zip_with("tokens", F.col("ideal.token"), lambda a, b: a == b), lambda x: x))
    return told.groupBy("cluster").agg(F.max_by("c", F.struct(agree.alias("agree"), (-F.col("c")).alias("c"))).alias("centre"))


def confirmed_links(
    docs: DataFrame, classes: DataFrame, clusters: DataFrame, key: str, text: str, group: int = GROUP, least: int = LEAST
) -> DataFrame:
    """``(u, v)`` links of classes of similarity ``least`` per cent and more, enough to connect all that links connect; ``clusters`` has ``(c, cluster)``."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    clusters = written_once(clusters.join(sizes, "cluster").select("c", "cluster", "size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([found.tobytes() for found in _sets(batch, 3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], sets], ["cluster", "size", "c", "set"])

    texts = docs.select(F.col(key).alias("c"), F.col(text).alias("text")).join(clusters, "c")
    found = texts.select("cluster", "size", "c", _word_hashes(F.col("text")).alias("w"))
    sets = written_once(found.mapInArrow(run, "cluster bigint, size bigint, c bigint, set binary").where(F.length("set") > 0))
    little = sets.where(F.col("size") <= group).select("cluster", "c", "set")
    links = little.repartition("cluster").sortWithinPartitions("cluster", "c").mapInArrow(lambda batches: _exact_groups(batches, least), "u bigint, v bigint")
    great = clusters.where(F.col("size") > group)
    if great.isEmpty():
        return links

    great_sets = sets.where(F.col("size") > group).select("cluster", "size", "c", "set")
    starred = written_once(_starred(great_sets, classes, group, least))
    links = links.unionByName(starred.where("star <> c").select(F.col("star").alias("u"), F.col("c").alias("v")))

    # What is not linked with the first centre: a few are compared with everything, of many only what shares a rare shingle.
    apart = starred.where("star <> first").groupBy("cluster").agg(F.count(F.lit(1)).alias("apart"))
    rows = great_sets.join(starred.select("cluster", "c", "star", "first"), ["cluster", "c"]).join(apart, "cluster")
    links = links.unionByName(_links_of_few(rows.where(F.col("apart") <= group), classes, group, least))
    many = rows.where(F.col("apart") > group).select("cluster", "size", "c", "star", "set")
    return links.unionByName(_confirmed_pairs(close_pairs(many, least), many, least))


def _starred(great_sets: DataFrame, classes: DataFrame, group: int, least: int) -> DataFrame:
    """``(cluster, c, star, first)``: the centre that a class is linked with, or itself, and its cluster's first centre.

    A cluster goes on with a next centre as long as more than ``group`` classes are left and half of them were linked,
    so that all rounds together compare twice its classes at most.
    """
    parts = F.ceil(F.col("size") / SLICE).cast("int")
    left, first, found = great_sets.select("cluster", "c"), None, []
    while True:
        centres = written_once(_centres(left.join(classes.select("c", "tokens"), "c")))
        first = centres.select("cluster", F.col("centre").alias("first")) if first is None else first
        heart = great_sets.join(centres.select("cluster", F.col("centre").alias("c")), ["cluster", "c"]).select(
            "cluster", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("c").alias("centre"), F.col("set").alias("centre_set")
        )
        rows = great_sets.join(left, ["cluster", "c"], "left_semi").select("cluster", F.pmod(F.xxhash64("c"), parts).cast("int").alias("part"), "c", "set")
        stars = rows.join(heart, ["cluster", "part"]).select("cluster", "c", "centre", "set", "centre_set")
        stars = written_once(stars.mapInArrow(lambda batches: _to_centre(batches, least), "cluster bigint, c bigint, centre bigint, linked boolean"))
        found.append(stars.where("linked").select("cluster", "c", F.col("centre").alias("star")))
        rest = stars.where("not linked").select("cluster", "c")
        worth = stars.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_if("linked").alias("linked"))
        worth = worth.where((F.col("n") - F.col("linked") > group) & (2 * F.col("linked") >= F.col("n"))).select("cluster")
        found.append(rest.join(worth, "cluster", "left_anti").select("cluster", "c", F.col("c").alias("star")))
        left = written_once(rest.join(worth, "cluster", "left_semi"))
        if left.isEmpty():
            break
    told = found[0]
    for more in found[1:]:
        told = told.unionByName(more)
    return told.join(first, "cluster").select("cluster", "c", "star", "first")


def _links_of_few(rows: DataFrame, classes: DataFrame, group: int, least: int) -> DataFrame:
    """Confirmed links of the classes apart from the first centre, at most ``group`` of each cluster, with all of their cluster."""
    many = F.ceil(F.col("size") / group).cast("int")
    carried = ["c", (F.col("star") == F.col("first")).alias("linked"), "bits", "set"]
    rows = rows.join(classes.select("c", "bits"), "c")
    ours = rows.where("star <> first").select(
        "cluster", F.lit(0).alias("block"), F.explode(F.sequence(F.lit(0), many - 1)).alias("other"), F.lit(0).alias("side"), *carried
    )
    others = rows.select("cluster", F.lit(0).alias("block"), F.pmod(F.xxhash64("c"), many).cast("int").alias("other"), F.lit(1).alias("side"), *carried)
    blocks = ours.unionByName(others).repartition("cluster", "block", "other").sortWithinPartitions("cluster", "block", "other", "side", "c")
    return blocks.mapInArrow(lambda batches: _exact_blocks(batches, least), "u bigint, v bigint")


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns ``cluster, set`` to ``cluster, bucket, n``: sets with a shingle in the bucket, those of a batch."""
    for batch in batches:
        clusters, place = np.unique(batch.column(0).to_numpy(), return_inverse=True)
        sets = [_as_set(x) for x in batch.column(1)]
        at = np.repeat(place.astype("i8"), [len(x) for x in sets]) * BUCKETS
        keys, n = np.unique(at + (np.concatenate(sets) >> _U(48)).astype("i8") if sets else at, return_counts=True)
        columns = [pa.array(clusters[keys // BUCKETS]), pa.array((keys % BUCKETS).astype("i4")), pa.array(n)]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "bucket", "n"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns ``cluster, size, counts`` (pairs of bucket and count) with the counts as an array of all buckets."""
    for batch in batches:
        for i in range(batch.num_rows):
            pairs = batch.column(2)[i].values
            table = np.zeros(BUCKETS, "<i8")
            table[pairs.field(0).to_numpy()] = pairs.field(1).to_numpy()
            columns = [*batch.slice(i, 1).columns[:2], pa.array([table.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "size", "counts"])


def _first_shingles(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The first shingles of each set, the rarest of its cluster; columns ``cluster, part, side, c, star, set``, a cluster's counts on side 0."""
    table = np.zeros(BUCKETS, "<i8")
    for batch in batches:
        cluster, side, c, star = (batch.column(i).to_numpy() for i in (0, 2, 3, 4))
        out: list[list[np.ndarray]] = [[] for _ in range(7)]
        for i in range(batch.num_rows):
            if side[i] == 0:
                table = np.frombuffer(batch.column(5)[i].as_buffer(), "<i8")
                continue
            found = _as_set(batch.column(5)[i])
            n = len(found)
            some = n + least * n // -100 + 1
            often = table[(found >> _U(48)).astype("i8")]
            first = np.argsort(often, kind="stable")[:some]
            here = np.arange(some)
            pieces = -(-often[first] // BLOCK)
            for values, more in zip(
                out, (np.full(some, cluster[i]), found[first].view("i8"), np.full(some, c[i]), np.full(some, star[i]), np.full(some, n), here, pieces)
            ):
                values.append(more)
        if out[0]:
            names = ["cluster", "shingle", "c", "star", "n", "place", "pieces"]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype("i8")) for x in out], names)


def _sharing(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Pairs that share a shingle and may still reach the bound; columns ``cluster, shingle, a, b, own, n, c, star, place``, sorted."""
    for table in _runs(batches, 4):
        bounds = _bounds(table, 4)
        a, b, own, n, c, star, place = (table.column(i).to_numpy() for i in range(2, 9))
        sizes = np.diff(bounds)
        left = np.repeat(bounds[1:], sizes) - np.arange(len(c)) - 1
        for step in range(1, int(sizes.max())):
            x = np.flatnonzero(left >= step)
            y = x + step
            both = -(-least * (n[x] + n[y]) // (100 + least))
            good = (star[x] != star[y]) & (place[x] + both <= n[x]) & (place[y] + both <= n[y]) & ((a[x] == b[x]) | (own[x] != own[y]))
            x, y = x[good], y[good]
            if len(x):
                columns = [pa.array(np.minimum(c[x], c[y])), pa.array(np.maximum(c[x], c[y]))]
                yield pa.RecordBatch.from_arrays(columns, ["u", "v"])


def close_pairs(members: DataFrame, least: int = LEAST) -> DataFrame:
    """``(u, v)``: pairs of a cluster, of different stars, among which are all of ``least`` per cent and more; ``members`` has
    ``(cluster, size, c, star, set)`` and is read twice.

    Counts are those of buckets of shingles, which orders them well enough; the pairs are right for any order. A shingle
    of many classes is cut into pieces, which meet two by two.
    """
    parts = F.ceil(F.col("size") / SLICE).cast("int")
    counts = members.select("cluster", "set").mapInArrow(_bucket_counts, "cluster bigint, bucket int, n bigint")
    counts = counts.groupBy("cluster", "bucket").agg(F.sum("n").alias("n"))
    counts = counts.groupBy("cluster").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))  # BUCKETS of each at most
    sizes = members.groupBy("cluster").agg(F.max("size").alias("size"))
    counts = counts.join(sizes, "cluster").select("cluster", "size", "counts").mapInArrow(_packed, "cluster bigint, size bigint, counts binary")
    none = F.lit(0).cast("bigint")
    tables = counts.select(
        "cluster", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("side"), none.alias("c"), none.alias("star"), F.col("counts").alias("set")
    )
    rows = members.select("cluster", F.pmod(F.xxhash64("c"), parts).cast("int").alias("part"), F.lit(1).alias("side"), "c", "star", "set")
    rows = tables.unionByName(rows).repartition("cluster", "part").sortWithinPartitions("cluster", "part", "side")
    first = rows.mapInArrow(
        lambda batches: _first_shingles(batches, least),
        "cluster bigint, shingle bigint, c bigint, star bigint, n bigint, place bigint, pieces bigint",
    )
    first = first.withColumn("own", F.pmod(F.xxhash64("c"), F.col("pieces"))).select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("other")
    )
    first = first.select("cluster", "shingle", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "n", "c", "star", "place")
    keys = ["cluster", "shingle", "a", "b"]
    met = first.repartition(*keys).sortWithinPartitions(*keys)
    return met.mapInArrow(lambda batches: _sharing(batches, least), "u bigint, v bigint").distinct()


def _confirmed_pairs(pairs: DataFrame, members: DataFrame, least: int) -> DataFrame:
    """The pairs that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [_linked(_as_set(a), _as_set(b), least) for a, b in zip(batch.column(2), batch.column(3))]
            yield batch.select(["u", "v"]).filter(pa.array(linked, pa.bool_()))

    told = pairs.join(members.select(F.col("c").alias("u"), F.col("set").alias("a")), "u")
    told = told.join(members.select(F.col("c").alias("v"), F.col("set").alias("b")), "v")
    return told.select("u", "v", "a", "b").mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``(key, n_shingles, component_id, kept)`` of every row; ids are integers."""
    signed = written_once(signatures(docs, key, text))
    alike = ["k1", "k2", "n_shingles"]
    present = signed.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    classes = present.groupBy(*alike).agg(F.min("id").cast("bigint").alias("c"), F.any_value("tokens").alias("tokens"), F.any_value("bits").alias("bits"))
    classes = written_once(classes)
    clusters = components(candidate_links(classes, least)).select(F.col("node").alias("c"), F.col("component").alias("cluster"))
    links = confirmed_links(docs, classes, written_once(clusters), key, text, least=least)
    found = components(links)
    of_class = classes.select(*alike, "c").join(found.select(F.col("node").alias("c"), "component"), "c", "left")
    of_class = of_class.select(*alike, F.coalesce("component", "c").alias("component"))
    told = signed.select("id", *alike).join(of_class, alike, "left")
    whole = F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.col("component")).otherwise(F.col("id"))
    rows = told.select(F.col("id").alias(key), "n_shingles", whole.alias("component_id"))
    return rows.select("*", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)).alias("kept"))


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component, with all their columns."""
    gone = near_duplicates(docs, key, text, least).where(~F.col("kept")).select(key).distinct()
    return docs.join(gone, key, "left_anti")
