"""The trie of conversation beginnings: who shares the first d turns, and what a prefix cache would save.

Turns are digested at once, so texts are not moved. A conversation is cut into chunks of ``CHUNK`` turns; the chunks of
one level form tries of their own, whose roots are the digests of everything before the chunk. Equal chunks below one
root are one path, with the number of their conversations and the smallest of them. The paths of a level are sorted
over the cluster and cut into shards: a hot beginning is spread over as many shards as its paths need.

In each shard the turns get dense numbers, and the paths are packed into a double array: ``base[s] + number`` is the
slot of a child of slot s, and ``check`` of that slot is s. All paths are then walked through the arrays, and counts,
smallest conversations, leaves and savings are summed from the slots of the deepest nodes upwards. Neighbouring shards
share only beginnings of the paths where they meet. Each of those nodes is owned by the first shard that has it; what a
node is counted once for (being a child or a leaf, its own bytes) is left to the owner, so a shared node's aggregates
are the sums over its shards, which one grouping by its digest gives. Nodes below it are whole in their shard.

Levels are worked from the deepest up: what lies below a chunk's last turn is joined to its path as three numbers. All
conversations of at most ``CHUNK`` turns are one level. A digest over the conversations that end at a node needs them in
their order; they are joined in blocks of neighbouring ids first, and the blocks of a node pass through one task one
after another. Sorting paths sends a sample of them to the driver, at most a million paths as Spark limits it.

Null roles and texts count as empty; a null turn comes first; rows with equal turns are ordered by their digests, and
repeated rows are turns of their own. Rows without a conversation id belong to none and are left out. An empty table
gives an empty one, without a root. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm import columns as C
from tributary.session import written_once

CHUNK = 512  # turns of a conversation that one level holds
SHARD = 65_536  # turns of the paths of a shard
SPAN = 16  # bits of the conversation ids that are joined as one block
HEADS = 5  # conversations that share their beginning with the first of them
DEPTHS = 9  # numbers of turns, from 0, that they share


def numbered(turns: DataFrame) -> DataFrame:
    """``(conv, pos, turn, size)``: each turn's place in its conversation from 1, its digest and its text's bytes.

    Rows are sorted over the cluster and numbered within a partition; what a conversation has in earlier partitions is
    added, so a conversation may lie in any number of them.
    """
    role, text = C.whole("role"), C.whole("text")
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("at"), digest.alias("turn"),
        F.octet_length(text).cast("bigint").alias("size"), F.monotonically_increasing_id().alias("row"),
    )
    dealt = written_once(rows.repartitionByRange("conv", "at", "turn", "row").select("conv", "at", "turn", "size", F.spark_partition_id().alias("part")))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begun = dealt.groupBy("part", "conv").agg(F.count("*").alias("n")).select("part", "conv", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("part", "conv").orderBy("at", "turn")
    return dealt.select("*", F.row_number().over(within).alias("nth")).join(begun, ["part", "conv"]).select("conv", (F.col("before") + F.col("nth")).alias("pos"), "turn", "size")


def shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations, ``(conv, pos, turn, size)``, and ``(conv, n)`` of all of them, turnless ones included.

    A conversation c begins with the first h turns of conversation c - c % ``HEADS``, as far as that has them, and goes
    on with its own after its first h; h is the CRC-32 of its decimal id modulo ``DEPTHS``.
    """
    lengths = turns.groupBy("conv").agg(F.max("pos").alias("n"))
    taken = (F.crc32(F.col("conv").cast("string").cast("binary")) % DEPTHS).alias("h")
    plan = lengths.select("conv", "n", (F.col("conv") - F.col("conv") % HEADS).alias("head"), taken)
    heads = lengths.select(F.col("conv").alias("head"), F.col("n").alias("head_n"))
    plan = written_once(plan.join(heads, "head", "left").select("conv", "n", "head", "h", F.least("h", F.coalesce("head_n", F.lit(0))).alias("got")))
    own = turns.join(plan.select("conv", "h", "got"), "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("got")).alias("pos"), "turn", "size")
    first = turns.where(F.col("pos") < DEPTHS).withColumnRenamed("conv", "head")
    copied = first.join(plan.where("got > 0").select("conv", "head", "got"), "head").where("pos <= got").select("conv", "pos", "turn", "size")
    return own.unionByName(copied), plan.select("conv", (F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def _path(rows: Column) -> tuple[Column, Column]:
    return F.transform(rows, lambda t: t["turn"]).alias("turns"), F.transform(rows, lambda t: t["size"]).alias("sizes")


def levels(rebuilt: DataFrame, lengths: DataFrame, chunk: int) -> list[tuple[DataFrame, DataFrame]]:
    """For each level its conversations, ``(conv, path, ends)``, and its distinct paths.

    Paths are ``(root, root_first, path, turns, sizes, n, first)``; ``path`` is the digest of the root and the turns.
    """
    level = F.floor((F.col("pos") - 1) / chunk).cast("bigint").alias("level")
    chunks = rebuilt.groupBy("conv", level).agg(F.sort_array(F.collect_list(F.struct("pos", "turn", "size"))).alias("rows"))
    chunks = written_once(chunks.select("conv", "level", *_path(F.col("rows"))))
    longest = lengths.agg(F.max("n")).first()[0] or 0
    none = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    here = lengths.join(chunks.where("level = 0").drop("level"), "conv", "left").select(
        "conv", "n", F.lit("").alias("root"), F.lit(None).cast("bigint").alias("root_first"),
        F.coalesce("turns", none[0]).alias("turns"), F.coalesce("sizes", none[1]).alias("sizes"),
    )
    found = []
    for k in range(max(1, math.ceil(longest / chunk))):
        path = F.md5(F.concat(F.col("root"), F.lit(":"), F.array_join("turns", "")))
        here = written_once(here.select("*", path.alias("path"), (F.col("n") <= (k + 1) * chunk).alias("ends")))
        paths = here.groupBy("root", "path").agg(
            F.first("root_first").alias("root_first"), F.first("turns").alias("turns"), F.first("sizes").alias("sizes"),
            F.count("*").alias("n"), F.min("conv").alias("first"),
        )
        paths = written_once(paths)
        found.append((here.select("conv", "path", "ends"), paths))
        above = here.where("not ends").select("conv", "n", "path").join(paths.select("path", "first"), "path")
        here = above.join(chunks.where(F.col("level") == k + 1).drop("level"), "conv").select(
            "conv", "n", F.col("path").alias("root"), F.col("first").alias("root_first"), "turns", "sizes"
        )
    return found


def _same(a: Column, b: Column) -> Column:
    """The length of the common beginning of two arrays without nulls; 0 where one is null."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    return F.coalesce(F.when(differs == 0, F.least(F.size(a), F.size(b))).otherwise(differs - 1), F.lit(0)).cast("int")


def sharded(paths: DataFrame, shard: int) -> DataFrame:
    """The paths, sorted over shards, with the shard's number and how far it shares its ends with its neighbours."""
    total = paths.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    dealt = written_once(paths.repartitionByRange(max(1, math.ceil(total / shard)), "root", "turns").withColumn("part", F.spark_partition_id()))
    whole = F.concat(F.array("root"), F.col("turns"))
    edges = dealt.groupBy("part").agg(F.min(whole).alias("low"), F.max(whole).alias("high"))
    along = Window.orderBy("part")  # one row a shard
    edges = edges.select("part", "low", "high", F.lag("high").over(along).alias("previous"), F.lead("low").over(along).alias("next"))
    edges = edges.select("part", _same(F.col("previous"), F.col("low")).alias("before"), _same(F.col("high"), F.col("next")).alias("after"), F.size("high").alias("size"))
    edges = edges.select("part", "before", "after", (F.col("after") == F.col("size")).alias("goes_on"))
    return dealt.join(F.broadcast(edges), "part")  # three numbers a shard


class DoubleArray:
    """A trie over numbers from 1 as BASE and CHECK. Slot 1 is the top; slot 0 is not used, a ``check`` of 0 is a free slot."""

    def __init__(self, paths: list[list[int]]):
        """``paths`` are sorted and distinct."""
        self.base, self.check = [0, 0], [-1, -1]
        self._used, self._low = np.ones(2, bool), 2
        self.order = [1]  # slots, parents first
        waiting = [(1, 0, 0, len(paths))]
        while waiting:
            slot, depth, low, high = waiting.pop()
            while low < high and len(paths[low]) == depth:
                low += 1
            if low == high:
                continue
            numbers, starts = [], []
            for i in range(low, high):
                number = paths[i][depth]
                if not numbers or number != numbers[-1]:
                    numbers.append(number)
                    starts.append(i)
            base = self.base[slot] = self._place(numbers)
            for number, start, end in zip(numbers, starts, [*starts[1:], high]):
                self.check[base + number] = slot
                self._used[base + number] = True
                self.order.append(base + number)
                waiting.append((base + number, depth + 1, start, end))

    def _place(self, numbers: list[int]) -> int:
        """A base that puts all children into free slots, the first of them as low as can be."""
        steps = np.array(numbers) - numbers[0]
        while self._low < len(self._used) and self._used[self._low]:
            self._low += 1
        start = self._low
        while True:
            self._reach(start + 256 + int(steps[-1]))
            free = start + np.flatnonzero(~self._used[start : start + 256])
            fits = free[~self._used[free[:, None] + steps].any(axis=1)] if len(free) else free
            if len(fits):
                return int(fits[0]) - numbers[0]
            start += 256

    def _reach(self, size: int) -> None:
        more = size - len(self._used)
        if more > 0:
            more = max(more, len(self._used))
            self._used = np.concatenate([self._used, np.zeros(more, bool)])
            self.base.extend([0] * more)
            self.check.extend([0] * more)

    def walk(self, path: list[int]) -> list[int]:
        """The slots of a path's nodes, without the top."""
        slot, slots, base, check = 1, [], self.base, self.check
        for number in path:
            below = base[slot] + number
            if check[below] != slot:
                raise KeyError(path)
            slots.append(below)
            slot = below
        return slots


_NODE = (
    "part int, is_root boolean, root string, depth bigint, first bigint, parent_first bigint, n bigint, children bigint, leaves bigint, "
    "saved bigint, path string, node string, parent_node string"
)


def _shard_nodes(level: int, chunk: int):
    """A function from the paths of a shard to rows of ``_NODE``; ``node`` is set for nodes shared with other shards."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["root"], r["turns"]))
        names = sorted({r["root"] for r in rows}.union(*(r["turns"] for r in rows)))
        dense = {name: i for i, name in enumerate(names, 1)}
        paths = [[dense[r["root"]], *(dense[t] for t in r["turns"])] for r in rows]
        trie = DoubleArray(paths)
        walks = [trie.walk(p) for p in paths]
        size, many = [0] * len(trie.check), [0] * len(trie.check)
        first: dict[int, int] = {}
        depth, path, root_first, root = {1: 0}, {}, {}, {}
        children, leaves, saved = many.copy(), many.copy(), many.copy()
        for r, slots in zip(rows, walks):
            root_first[slots[0]], root[slots[0]] = r["root_first"], r["root"]
            for slot, bytes_ in zip(slots, [0, *r["sizes"]]):
                size[slot] = bytes_
                many[slot] += r["n"]
                if slot not in first or r["first"] < first[slot]:
                    first[slot] = r["first"]
            end = slots[-1]
            path[end] = r["path"]
            children[end], leaves[end], saved[end] = r["below_children"], r["below_leaves"], r["below_saved"]
        before, after, goes_on = rows[0]["before"], rows[0]["after"], rows[0]["goes_on"]
        seen_before = set(walks[0][:before])  # owned by an earlier shard
        shared = {}
        for r, slots, most in ((rows[0], walks[0], before), (rows[-1], walks[-1], after)):
            digest = hashlib.md5(r["root"].encode())
            for slot, turn in zip(slots[:most], ["", *r["turns"]]):
                digest.update(f"/{turn}".encode())
                shared[slot] = digest.hexdigest()
        check = trie.check
        for slot in trie.order[1:]:
            depth[slot] = depth[check[slot]] + 1
        not_leaf = walks[-1][-1] if goes_on else None
        for slot in reversed(trie.order[1:]):
            owned = slot not in seen_before
            leaves[slot] += owned and children[slot] == 0 and slot != not_leaf
            saved[slot] += (many[slot] - owned) * size[slot]
            above = check[slot]
            children[above] += owned
            leaves[above] += leaves[slot]
            saved[above] += saved[slot]
        order = trie.order[1:]
        above = [check[s] for s in order]
        columns = [
            [rows[0]["part"]] * len(order), [d == 1 for d in map(depth.get, order)], [root.get(s) for s in order], [level * chunk + depth[s] - 1 for s in order],
            [first[s] for s in order],
            [root_first[a] if depth[a] == 1 and level else None if a == 1 or a in shared else first[a] for a in above],
            [many[s] for s in order], [children[s] for s in order], [leaves[s] for s in order], [saved[s] for s in order], [path.get(s) for s in order],
            [shared.get(s) for s in order], [None if depth[a] == 1 and level else shared.get(a) for a in above],
        ]
        kinds = [pa.int32(), pa.bool_(), pa.string(), *[pa.int64()] * 7, pa.string(), pa.string(), pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split(" ")[0] for f in _NODE.split(", ")])

    return run


def _merged(found: DataFrame) -> DataFrame:
    """Nodes of the shards' rows: shared ones summed, each with the smallest conversation of its parent."""
    sums = found.where("node is not null").groupBy("node").agg(
        *[F.max(c).alias(c) for c in ("is_root", "depth", "parent_first", "path", "parent_node")], F.min("first").alias("first"),
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
    )
    kept = ["is_root", "depth", "first", "parent_first", "n", "children", "leaves", "saved", "path"]
    smallest = sums.select("node", F.col("first").alias("node_first"))
    local = found.where("node is null and parent_node is null").select(*kept)
    # A shared node may have very many children: they are joined shard by shard.
    edges = found.where("node is not null").select("part", "node").join(smallest, "node").select("part", F.col("node").alias("parent_node"), "node_first")
    below = found.where("node is null and parent_node is not null").join(edges, ["part", "parent_node"])
    upper = sums.join(smallest.withColumnRenamed("node", "parent_node"), "parent_node", "left")
    named = [F.coalesce("node_first", "parent_first").alias("parent_first") if c == "parent_first" else F.col(c) for c in kept]
    return local.unionByName(below.select(*named)).unionByName(upper.select(*named))


def ends_digests(ends: DataFrame) -> DataFrame:
    """``(path, ends_sha256)`` of ``(path, conv)``: over the decimal ids in ascending order, joined by commas."""
    block = F.shiftright("conv", SPAN).alias("block")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    blocks = ends.groupBy("path", block).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, digest = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for here, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if here == path:
                    digest.update(b"," + ids.encode())
                    continue
                if digest:
                    done.append((path, digest.hexdigest()))
                path, digest = here, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([{"path": p, "ends_sha256": d} for p, d in done], pa.schema([("path", pa.string()), ("ends_sha256", pa.string())]))
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest.hexdigest()])], ["path", "ends_sha256"])

    ordered = blocks.repartition("path").sortWithinPartitions("path", "block").select("path", "ids")
    return ordered.mapInArrow(run, "path string, ends_sha256 string")


def trie(rebuilt: DataFrame, lengths: DataFrame, chunk: int = CHUNK, shard: int = SHARD) -> DataFrame:
    """Every node of the trie of conversations ``(conv, pos, turn, size)``; ``lengths`` has ``(conv, n)``, also for n = 0.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``: the smallest member of
    the node and of its parent, its members and children, the leaves of its subtree, and over its subtree the bytes of the
    last text times the members but one. The digest is over the members that have no further turn.
    """
    found = levels(rebuilt, lengths, chunk)
    nodes, below = [], None
    for k in reversed(range(len(found))):
        paths = found[k][1]
        if below is None:
            paths = paths.select("*", *[F.lit(0).cast("bigint").alias(f"below_{c}") for c in ("children", "leaves", "saved")])
        else:
            paths = paths.join(below, "path", "left").na.fill(0, [f"below_{c}" for c in ("children", "leaves", "saved")])
        made = written_once(sharded(paths, shard).groupBy("part").applyInArrow(_shard_nodes(k, chunk), _NODE))
        below = made.where("is_root").groupBy(F.col("root").alias("path")).agg(*[F.sum(c).alias(f"below_{c}") for c in ("children", "leaves", "saved")])
        level = _merged(made)
        nodes.append(level.where("not is_root") if k else level)
    each = nodes[0]
    for more in nodes[1:]:
        each = each.unionByName(more)
    ends = found[0][0]
    for more, _ in found[1:]:
        ends = ends.unionByName(more)
    each = each.join(ends_digests(ends.where("ends").select("path", "conv")), "path", "left")
    return each.select(
        F.col("first").alias("conv_id"), "depth", F.col("parent_first").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def rebuilt_trie(turns: DataFrame, chunk: int = CHUNK, shard: int = SHARD) -> DataFrame:
    """The trie of the rebuilt conversations of ``(conv_id, turn, role, text)``."""
    return trie(*shared_heads(written_once(numbered(turns))), chunk, shard)
