"""Benchmark passages in documents, also paraphrased ones, by latent semantic retrieval.

Texts are cut into windows of two blocks of words, each window a TF-IDF vector over hashed words. A randomised singular
value decomposition of all windows (one pass: the Gram matrix times a random matrix, then Nyström's formula) gives a
latent space whose directions are scaled to equal variance. Windows whose cosine with a window of a benchmark item
reaches ``COSINE`` are candidates; of these, windows stay that hold ``CONTAINED`` of the weight of the item window's
words. Windows that share a run of ``RUN`` words with an item are candidates without a cosine or a weight, so an item whose
answer stands in a document is always compared, and so is one of which up to a quarter of the words were replaced or left
out: what is left of it holds such a run (two words for items of up to ``SHORT`` words). A candidate is a leak if the longest common subsequence of the item and the words
around the window covers ``SURE`` of the item, or ``LIKELY`` of it while the item's answer, its last words, stands
there.

Word frequencies and the decomposition cover all documents; tasks sum them first and their sums are added up in two
steps. Their size is fixed by ``FEATURES`` and ``RANK``. The items are a query set: blocks of bounded size are sent to
the tasks, as many searches as there are blocks. Documents are never shuffled and each is searched within its row.

Null texts count as empty; documents and items without words have no leaks. Rows repeated exactly, in either table,
give the same leaks, listed once; rows that share an id are searched each. Null ids are reported as null. Further columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm import columns as C
from tributary.session import written_once

BLOCK = 16  # words; a window is two blocks
FEATURES = 4096  # a power of two
RANK = 64
COMMON = 8
COSINE = 0.5  # of the cosine that a window reaches which holds the item window whole
CONTAINED = 0.4  # of an item window's weight that a candidate window must hold
SURE, LIKELY = 0.75, 0.55
ANSWER = 3  # last words of an item
STEP = 4  # words between an item's windows
RUN, SHORT = 3, 8
CACHED = 1024  # blocks whose vectors are summed at once
SLOTS = 1 << 20  # of the table that runs are looked up in first
ITEM_WORDS = 100_000  # words of items that are searched for at once
_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def word_codes(text: Column) -> Column:
    """A 32-bit code of each word, in lower case and without punctuation."""
    words = F.array_remove(F.split(F.lower(C.whole(text)), _BREAK), "")
    return F.transform(words, lambda w: F.hash(w))


@dataclass(frozen=True)
class Cut:
    """The words of some texts, one after another, and their blocks and windows."""

    features: np.ndarray  # of each word
    starts: np.ndarray  # of blocks
    slots: np.ndarray  # of each block the features of its words that have a weight; free slots hold FEATURES
    left: np.ndarray  # first block of each window
    right: np.ndarray  # second block; equal to the first for a text of one block
    owner: np.ndarray  # text of each window
    first: np.ndarray  # place of the window's first word in its text


def cut(codes: np.ndarray, ends: np.ndarray, idf: np.ndarray) -> Cut:
    """``codes`` of texts that end at ``ends[1:]``."""
    counts = np.diff(ends)
    blocks = -(-counts // BLOCK)
    owner = np.repeat(np.arange(len(counts)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = ends[:-1][owner] + nth * BLOCK
    last = nth == blocks[owner] - 1
    opens = ~last | (nth == 0)  # every block but a text's last begins a window
    left = np.flatnonzero(opens)
    right = np.where(last[left], left, left + 1)
    features = (codes.view("u4") & (FEATURES - 1)).astype("u2")
    sizes = np.diff(np.append(starts, len(features)))
    slots = np.full((len(starts), BLOCK), FEATURES, "u2")
    slots[np.repeat(np.arange(len(starts)), sizes), np.arange(len(features)) - np.repeat(starts, sizes)] = features
    slots[~np.take(np.append(idf > 0, False), slots)] = FEATURES
    return Cut(features, starts, slots, left, right, owner[left], nth[left] * BLOCK)


def _batches(batch: pa.RecordBatch, column: int, words: int = 200_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Stretches of rows with about ``words`` words: first row, codes, ends."""
    lists = batch.column(column)
    ends, values = lists.offsets.to_numpy().astype("i8"), lists.values.to_numpy(zero_copy_only=False)
    begin = 0
    while begin < len(lists):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + words, side="right")) - 1)
        yield begin, values[ends[begin] : ends[end]], ends[begin : end + 1] - ends[begin]
        begin = end


def _window_sums(found: Cut, rows: np.ndarray) -> np.ndarray:
    """Sums over the weighed words of each window of ``rows[feature]``, some blocks at a time so that they stay in the cache."""
    padded = np.concatenate([rows, np.zeros((1, rows.shape[1]), "f4")])
    blocks = np.zeros((len(found.starts), rows.shape[1]), "f4")
    held = np.empty((CACHED, rows.shape[1]), "f4")
    for start in range(0, len(blocks), CACHED):
        part, sums = found.slots[start : start + CACHED], blocks[start : start + CACHED]
        for slot in range(BLOCK):
            np.take(padded, part[:, slot], axis=0, out=held[: len(part)], mode="clip")
            sums += held[: len(part)]
    sums = blocks[found.left] + blocks[found.right]
    sums[found.left == found.right] *= 0.5
    return sums


def _feature_sums(found: Cut, back: np.ndarray, total: np.ndarray) -> None:
    """Adds each block's row of ``back`` to the rows of ``total`` of its weighed words."""
    block, slot = np.nonzero(found.slots < FEATURES)
    features = found.slots[block, slot]
    order = np.argsort(features, kind="stable")
    block, features = block[order], features[order]
    for start in range(0, len(features), 4 * CACHED):
        which = features[start : start + 4 * CACHED]
        begins = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
        total[which[begins]] += np.add.reduceat(np.take(back, block[start : start + 4 * CACHED], axis=0, mode="clip"), begins, axis=0)


def _summed(parts: DataFrame, kind: str) -> np.ndarray:
    """The sum of arrays that tasks return in parts ``(part, salt, bytes)``, first of some tasks and then of all."""

    def add(keys: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple, np.ndarray] = {}
            for batch in batches:
                for part, salt, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    at = (part, salt if keys == 2 else 0)
                    array = np.frombuffer(value.as_buffer(), kind)
                    sums[at] = sums[at] + array if at in sums else array
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()),
                    pa.array([v.tobytes() for v in sums.values()], pa.binary()),
                ],
                ["part", "salt", "bytes"],
            )

        return run

    shape = "part int, salt int, bytes binary"
    some = parts.repartition("part", "salt").mapInArrow(add(2), shape)
    rows = some.repartition("part").mapInArrow(add(1), shape).collect()  # one row a part
    return np.concatenate([np.frombuffer(r["bytes"], kind) for r in sorted(rows, key=lambda r: r["part"])]) if rows else np.zeros(0, kind)


def _parts(array: np.ndarray, salt: int, pieces: int = 8) -> pa.RecordBatch:
    cuts = np.array_split(array, pieces)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(range(pieces), pa.int32()), pa.array([salt] * pieces, pa.int32()),
            pa.array([c.tobytes() for c in cuts], pa.binary()),
        ],
        ["part", "salt", "bytes"],
    )


def _task(group: int = 32) -> int:
    return TaskContext.get().partitionId() // group


def inverse_frequencies(coded: DataFrame) -> np.ndarray:
    """For each feature the logarithm of all words over its words; 0 for features ``COMMON`` times as frequent as
    those that occur are on average, which say nothing of a passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(FEATURES, "i8")
        for batch in batches:
            for _, codes, _ in _batches(batch, 0):
                counts += np.bincount(codes.view("u4") & (FEATURES - 1), minlength=FEATURES)
        yield _parts(counts, _task())

    counts = _summed(coded.select("w").mapInArrow(run, "part int, salt int, bytes binary"), "i8")
    if not counts.size:
        counts = np.zeros(FEATURES, "i8")
    idf = np.log((counts.sum() + 1) / (counts + 1)).astype("f4")
    idf[counts * (counts > 0).sum() >= COMMON * max(1, counts.sum())] = 0
    return idf


def latent_space(coded: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 5) -> np.ndarray:
    """``FEATURES`` x ``rank``: word features to latent coordinates of equal variance."""
    rng = np.random.default_rng(seed)
    omega = rng.standard_normal((FEATURES, rank)).astype("f4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.concatenate([idf[:, None] * omega, idf[:, None] ** 2], axis=1)
        total = np.zeros((FEATURES, rank), "f4")
        for batch in batches:
            for _, codes, ends in _batches(batch, 0):
                if not len(codes):
                    continue
                found = cut(codes, ends, idf)
                sums = _window_sums(found, table)
                seen = sums[:, :rank] / np.maximum(sums[:, rank:], 1e-6)  # row times omega over its squared length
                back = np.zeros((len(found.starts), rank), "f4")
                back[found.left] += seen
                two = found.left != found.right
                back[found.right[two]] += seen[two]
                _feature_sums(found, back, total)
        total *= idf[:, None]
        yield _parts(total.ravel(), _task())

    z = _summed(coded.select("w").mapInArrow(run, "part int, salt int, bytes binary"), "f4")
    if not z.size or not np.abs(z).any():
        return np.zeros((FEATURES, rank), "f4")
    z = z.reshape(FEATURES, rank).astype("f8")
    middle = omega.T.astype("f8") @ z
    values, vectors = np.linalg.eigh((middle + middle.T) / 2)
    kept = values > values[-1] * 1e-8
    half = z @ (vectors[:, kept] / np.sqrt(values[kept]))  # half @ half.T approximates the Gram matrix
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    kept = s > s[0] * 1e-6 if len(s) else s > 0
    space = np.zeros((FEATURES, rank), "f4")
    space[:, : kept.sum()] = idf[:, None] * (u[:, kept] / s[kept])
    return space


def lcs(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence of ``words`` and an item of ``length`` words; ``masks`` has the places of its words as bits."""
    full = (1 << length) - 1
    free = full
    for word in words:
        mask = masks.get(word)
        if mask is not None:
            hit = free & mask
            free = ((free + hit) | (free - hit)) & full
    return length - free.bit_count()


@dataclass(frozen=True)
class Item:
    item_id: object
    words: tuple[int, ...]

    def masks(self) -> dict[int, int]:
        found: dict[int, int] = {}
        for i, word in enumerate(self.words):
            found[word] = found.get(word, 0) | (1 << i)
        return found


@dataclass(frozen=True)
class Asked:
    """The windows of the items: unit vectors by the cosine to reach, the item of each, the features in it, their weight,
    and whether a cosine is asked for at all."""

    vectors: np.ndarray
    owner: np.ndarray
    holds: np.ndarray
    weight: np.ndarray
    always: np.ndarray


def _windows(items: list[Item], space: np.ndarray, idf: np.ndarray, cosine: float = COSINE) -> Asked:
    vectors, owner, holds, weight, square = [], [], [], [], []
    for number, item in enumerate(items):
        f = np.array(item.words, dtype="i8") & (FEATURES - 1)
        for start in range(0, max(1, len(f) - 2 * BLOCK + STEP), STEP):
            part = f[start : start + 2 * BLOCK]
            vectors.append(space[part].sum(axis=0))
            owner.append(number)
            inside = np.zeros(FEATURES, bool)
            inside[part] = True
            holds.append(inside)
            weight.append(idf[part].sum())
            square.append((idf[part] ** 2).sum())
    block = np.array(vectors, "f4").reshape(len(owner), space.shape[1])
    block /= np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-9)
    # A short item fills its window in part only: its cosine is at most the root of its share of a usual window.
    usual = 2 * BLOCK * float((np.exp(-idf) * idf**2).sum())
    bound = cosine * np.sqrt(np.minimum(1.0, np.array(square) / max(usual, 1e-9)))
    bound = bound.astype("f4")
    block /= np.where(bound > 0, bound, 1)[:, None]
    return Asked(block, np.array(owner), np.array(holds), np.array(weight, "f4"), np.flatnonzero(bound == 0))


def run_codes(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit code of each run of ``size`` words."""
    total = np.full(max(0, len(codes) - size + 1), size, dtype="u8")
    for i in range(size if len(total) else 0):
        total = (total + codes[i : len(total) + i].view("u4")) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(32)
    return total


@dataclass(frozen=True)
class Runs:
    """The runs of one size of the items: their codes in order, the items of each, and a table of slots they take."""

    size: int
    codes: np.ndarray
    begins: np.ndarray
    items: np.ndarray
    taken: np.ndarray


def item_runs(items: list[tuple[int, ...]]) -> list[Runs]:
    by_size: dict[int, set[tuple[int, int]]] = {}
    for number, words in enumerate(items):
        size = RUN if len(words) > SHORT else min(2, len(words))
        runs = run_codes(np.array(words, "i4"), size)
        by_size.setdefault(size, set()).update((code, number) for code in runs.tolist())
    out = []
    for size, pairs in sorted(by_size.items()):
        ordered = sorted(pairs)
        codes, begins = np.unique(np.array([c for c, _ in ordered], "u8"), return_index=True)
        taken = np.zeros(SLOTS, bool)
        taken[codes & np.uint64(SLOTS - 1)] = True
        out.append(Runs(size, codes, np.append(begins, len(ordered)), np.array([i for _, i in ordered]), taken))
    return out


def shared_runs(found: Cut, codes: np.ndarray, ends: np.ndarray, runs: list[Runs]) -> set[tuple[int, int]]:
    """``(window, item)`` pairs of the windows whose text shares a run with an item there."""
    pairs: set[tuple[int, int]] = set()
    for asked in runs:
        here = run_codes(codes, asked.size)
        at = np.flatnonzero(np.take(asked.taken, (here & np.uint64(SLOTS - 1)).view("i8")))
        place = np.minimum(np.searchsorted(asked.codes, here[at]), len(asked.codes) - 1)
        same = asked.codes[place] == here[at]
        at, place = at[same], place[same]
        block = np.searchsorted(found.starts, at, side="right") - 1
        window = np.searchsorted(found.left, block, side="right") - 1  # a text's last block is in the window before
        inside = at + asked.size <= ends[found.owner[window] + 1]
        window, place = window[inside], place[inside]
        each = np.unique(np.stack([window, place], axis=1), axis=0)
        for w, p in each.tolist():
            pairs.update((w, i) for i in asked.items[asked.begins[p] : asked.begins[p + 1]].tolist())
    return pairs


def candidates(found: Cut, space: np.ndarray, asked: Asked, idf: np.ndarray, step: int = 512) -> list[tuple[int, int]]:
    """``(window, item)`` pairs whose cosine reaches the bound and whose window holds enough of the item window's weight."""
    sums = _window_sums(found, space)
    sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    sizes = np.diff(np.append(found.starts, len(found.features)))
    begin = found.starts[found.left]
    length = sizes[found.left] + np.where(found.left == found.right, 0, sizes[found.right])
    pairs: set[tuple[int, int]] = set()
    for start in range(0, len(sums), step):
        reached = sums[start : start + step] @ asked.vectors.T >= 1
        reached[:, asked.always] = True
        window, hit = np.divmod(np.flatnonzero(reached), reached.shape[1])
        window += start
        held = np.zeros(len(window), "f4")
        for i in range(2 * BLOCK):
            there = i < length[window]
            feature = found.features[np.minimum(begin[window] + i, len(found.features) - 1)]
            held += np.where(there & asked.holds[hit, feature], idf[feature], 0)
        enough = held >= CONTAINED * asked.weight[hit]
        pairs.update(zip(window[enough].tolist(), asked.owner[hit[enough]].tolist()))
    return sorted(pairs)


def _answered(answer: tuple[int, ...], words: list[int]) -> bool:
    n = len(answer)
    return any(tuple(words[i : i + n]) == answer for i in range(len(words) - n + 1))


def _search(coded: DataFrame, items: list[Item], space: np.ndarray, idf: np.ndarray, cosine: float) -> DataFrame:
    """``(id, item, share, first, last, answered)`` of every leak of these items; ``item`` is a place in the list."""
    asked = _windows(items, space, idf, cosine)
    windows = (asked.vectors, asked.owner, asked.holds, asked.weight, asked.always)
    words = [i.words for i in items]
    sent = coded.sparkSession.sparkContext.broadcast((*windows, space, words, item_runs(words)))
    latent = bool(space.any())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *windows, space, words, runs = sent.value
        asked = Asked(*windows)
        masks = [Item(None, w).masks() for w in words]
        for batch in batches:
            out: list[tuple] = []
            for begin, codes, ends in _batches(batch, 1):
                if not len(codes):
                    continue
                found = cut(codes, ends, idf)
                best: dict[tuple[int, int], tuple] = {}
                pairs = shared_runs(found, codes, ends, runs)
                if latent:
                    pairs.update(candidates(found, space, asked, idf))
                for window, item in sorted(pairs):
                    text = int(found.owner[window])
                    n = len(words[item])
                    low = max(0, int(found.first[window]) - n)
                    high = min(int(ends[text + 1] - ends[text]), int(found.first[window]) + 2 * BLOCK + n)
                    around = codes[ends[text] + low : ends[text] + high].tolist()
                    share = lcs(masks[item], n, around) / n
                    if share < LIKELY:
                        continue
                    answered = _answered(words[item][-ANSWER:], around)
                    if share >= SURE or answered:
                        best[text, item] = max(best.get((text, item), (-1.0,)), (share, -low, high, answered))
                out += [(begin + text, item, *told) for (text, item), told in best.items()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([o[0] for o in out], pa.int32())), pa.array([o[1] for o in out], pa.int32()),
                    pa.array([o[2] for o in out], pa.float64()), pa.array([-o[3] for o in out], pa.int32()),
                    pa.array([o[4] for o in out], pa.int32()), pa.array([o[5] for o in out], pa.bool_()),
                ],
                ["id", "item", "share", "first", "last", "answered"],
            )

    kind = coded.schema["id"].dataType.simpleString()
    return coded.select("id", "w").mapInArrow(run, f"id {kind}, item int, share double, first int, last int, answered boolean")


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", cosine: float = COSINE,
) -> DataFrame:
    """``(key, item, share, first, last, answered)``: items found in documents, the share of the item's words that stand
    in order between words ``first`` and ``last`` of the document, and whether its answer does."""
    spark = docs.sparkSession
    coded = written_once(docs.select(F.col(key).alias("id"), word_codes(F.col(text)).alias("w")))
    idf = inverse_frequencies(coded)
    space = latent_space(coded, idf)
    asked = benchmark.select(F.col(item).alias("item_id"), word_codes(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    asked = written_once(asked.distinct())
    blocks = asked.agg(F.ceil(F.coalesce(F.sum(F.size("w")), F.lit(0)) / ITEM_WORDS).cast("int")).first()[0]
    id_kind, item_kind = coded.schema["id"].dataType, asked.schema["item_id"].dataType
    found = spark.createDataFrame(
        [], f"{key} {id_kind.simpleString()}, {item} {item_kind.simpleString()}, share double, first int, last int, answered boolean"
    )
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "w"), F.lit(blocks)) == block).orderBy("item_id", "w").collect()
        items = [Item(r["item_id"], tuple(r["w"])) for r in rows]
        if not items:
            continue
        names = spark.createDataFrame([(i, x.item_id) for i, x in enumerate(items)], f"n int, {item} {item_kind.simpleString()}")
        hits = _search(coded, items, space, idf, cosine).join(F.broadcast(names), F.col("item") == F.col("n"))
        found = found.unionByName(hits.select(F.col("id").alias(key), item, "share", "first", "last", "answered"))
    return found.distinct()


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found, with all their columns."""
    found = leaks(docs, benchmark, key, text).select(F.col(key).alias("__gone")).distinct()
    return docs.join(found, F.col(key).eqNullSafe(F.col("__gone")), "left_anti")
