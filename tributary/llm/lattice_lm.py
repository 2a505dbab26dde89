"""Language-model scores by subword lattices.

The pieces of an existing subword vocabulary span a lattice over each word; every path is a segmentation. The
vocabulary's scores weight all segmentations of the training words, and the pieces' expected counts give their
probabilities (one step of expectation and maximisation). A word's probability is the sum over all its segmentations,
by the forward recursion in log space; a text's is the product over its words and an end mark. Beside it stands the
plain unigram score of whole words.

Words are counted over all documents, in each task first. Each distinct word passes the lattice once, wherever it
stands. Counts and scores come back to the documents in two ways: those of the ``HOT`` most frequent words, a fixed
number, are sent to the tasks, which sum them per document; the other words, none of them frequent, are joined. So no
word's occurrences meet in one task.

Words are runs of characters other than space and U+0009 to U+000D, with A-Z in lower case. Null texts count as
empty and have the end mark alone; without training documents pieces keep the weights of the vocabulary. Each input
row gives one output row, repeated rows and null ids included (a null id is not held out); further columns are not
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm import columns as C
from tributary.session import written_once

HOT = 100_000
START = "▁"  # begins a word's first piece
SMOOTHING = 0.1  # added to each piece's expected count


@dataclass(frozen=True)
class Pieces:
    """Natural logarithms of the probabilities of pieces, single bytes and the end."""

    pieces: dict[str, float]
    bytes: tuple[float, ...]
    end: float


def read_pieces(path: str) -> Pieces:
    """The pieces of a vocabulary file, weighted by its scores.

    Scores that are ranks (0, -1, -2, ...) give weights that fall as the inverse of the rank; others are logarithms.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    usual = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    scores = {model.id_to_piece(i): model.get_score(i) for i in usual if model.get_score(i) > -1e8}
    if all(s == int(s) for s in scores.values()):
        scores = {piece: -math.log(3 - s) for piece, s in scores.items()}
    low = min(scores.values())
    spelled = [low] * 256
    logs = _normed({**scores, **{bytes([b]): v for b, v in enumerate(spelled)}, None: low})
    return Pieces({p: v for p, v in logs.items() if isinstance(p, str)}, tuple(logs[bytes([b])] for b in range(256)), logs[None])


def _normed(logs: dict) -> dict:
    values = np.array(list(logs.values()))
    total = values.max() + math.log(np.exp(values - values.max()).sum())
    return {k: v - total for k, v in logs.items()}


SHORT = 40  # characters up to which products of probabilities stay far from the smallest float


def _shared(a: str, b: str) -> int:
    """How many characters two words begin with in common."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Lattice:
    """Sums over the segmentations of words.

    What a beginning of a word sums up to does not depend on what follows, so of words in order each takes over the
    sums of the beginning it shares with the one before; the work is that of the words' distinct beginnings.
    """

    def __init__(self, model: Pieces):
        self.model = model
        self.logs = list(model.pieces.values())
        self.spelled: dict[str, int] = {}  # characters that are no piece: numbers behind those of the pieces
        self.ending: dict = {}  # pieces by their characters from the last to the first; "" holds the number
        for number, piece in enumerate(model.pieces):
            node = self.ending
            for character in reversed(piece):
                node = node.setdefault(character, {})
            node[""] = number

    def _spelled(self, character: str) -> int:
        number = self.spelled.get(character)
        if number is None:
            number = self.spelled[character] = len(self.logs)
            self.logs.append(sum([self.model.bytes[b] for b in character.encode("utf-8", "replace")]))
        return number

    def arriving(self, text: str, end: int) -> list[tuple[int, int]]:
        """``(start, number)`` of the pieces that end at a place. A character that is no piece is spelled in bytes."""
        found, node, i = [], self.ending, end
        while i > 0:
            i -= 1
            node = node.get(text[i])
            if node is None:
                break
            number = node.get("")
            if number is not None:
                found.append((i, number))
        if not found or found[0][0] != end - 1:
            found.append((end - 1, self._spelled(text[end - 1])))
        return found

    def _arrived(self, text: str, end: int, sums: list[float]) -> float:
        """The logarithm of the summed probability of the beginning that ends at ``end``."""
        found = self.arriving(text, end)
        logs = self.logs
        if len(found) == 1:
            start, number = found[0]
            return sums[start] + logs[number]
        ways = [sums[start] + logs[number] for start, number in found]
        most, exp = max(ways), math.exp
        return most + math.log(sum([exp(way - most) for way in ways]))

    def all_logs(self, words: Iterable[str]) -> Iterator[float]:
        """The logarithm of each word's probability, over all segmentations."""
        sums, before = [0.0], ""
        for word in words:
            text = START + word
            shared = _shared(before, text)
            del sums[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                sums.append(self._arrived(text, end, sums))
            before = text
            yield sums[-1]

    def log(self, word: str) -> float:
        return next(self.all_logs([word]))

    def expected(self, words: Iterable[tuple[str, float]]) -> tuple[np.ndarray, np.ndarray]:
        """How often each piece and each single byte is expected in ``(word, times)``, over all segmentations.

        A word's weight goes back from its end over the pieces that arrive there. Weights of words with a common
        beginning are added up before they go on.
        """
        counts: dict[int, float] = {}
        arriving, sums, weight, before = [[]], [1.0], [0.0], ""

        def leave(keep: int) -> None:
            """Sends the weight of the places beyond ``keep`` back."""
            for end in range(len(sums) - 1, keep, -1):
                here = weight.pop()
                sums.pop()
                for start, number, chance in arriving.pop():
                    part = chance * here
                    weight[start] += part
                    counts[number] = counts.get(number, 0.0) + sums[start] * part

        exp = math.exp
        for word, times in words:
            text = START + word
            if len(text) > SHORT:
                self._long(text, times, counts)
                continue
            shared = _shared(before, text)
            leave(shared)
            for end in range(shared + 1, len(text) + 1):
                found = [(start, number, exp(self.logs[number])) for start, number in self.arriving(text, end)]
                arriving.append(found)
                sums.append(sum([sums[start] * chance for start, _, chance in found]))
                weight.append(0.0)
            weight[-1] += times / sums[-1]
            before = text
        leave(0)
        pieces, spelled = np.zeros(len(self.model.pieces)), np.zeros(256)
        characters = {number: c for c, number in self.spelled.items()}
        for number, n in counts.items():
            if number < len(pieces):
                pieces[number] += n
            else:
                for b in characters[number].encode("utf-8", "replace"):
                    spelled[b] += n
        return pieces, spelled

    def _long(self, text: str, times: float, counts: dict[int, float]) -> None:
        """The same for one long word, with logarithms."""
        arriving, sums, exp = [[]], [0.0], math.exp
        for end in range(1, len(text) + 1):
            arriving.append(self.arriving(text, end))
            sums.append(self._arrived(text, end, sums))
        weight = [-math.inf] * len(sums)
        weight[-1] = math.log(times) - sums[-1]
        for end in range(len(text), 0, -1):
            here = weight[end]
            for start, number in arriving[end]:
                part, old = self.logs[number] + here, weight[start]
                low, high = (old, part) if old < part else (part, old)
                weight[start] = high + math.log1p(exp(low - high))
                counts[number] = counts.get(number, 0.0) + exp(sums[start] + part)


def is_held_out(key: str, folds: int = 7, held_out: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == held_out, F.lit(False))


def word_counts(docs: DataFrame, held_out: Column, text: str = "text") -> DataFrame:
    """``(word, c, every)``: occurrences in training documents, and in all; in order within each task."""
    rows = docs.select((~held_out).cast("bigint").alias("learns"), F.explode(C.words(C.ascii_lower(C.whole(text)))).alias("word"))
    counted = rows.groupBy("word").agg(F.sum("learns").alias("c"), F.count(F.lit(1)).alias("every"))
    return counted.sortWithinPartitions("word")


def fitted(counts: DataFrame, ends: int, start: Pieces) -> Pieces:
    """Piece probabilities from the expected counts over the training words, and ``ends`` texts that ended."""
    names = list(start.pieces)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = (pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        values = np.concatenate(Lattice(start).expected(words))
        ids = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype("i4")), pa.array(values[ids])], ["piece", "n"])

    told = counts.where("c > 0").select("word", "c").mapInArrow(expect, "piece int, n double")
    summed = {r["piece"]: r["n"] for r in told.groupBy("piece").agg(F.sum("n").alias("n")).collect()}  # one row a piece
    if not ends:
        return start
    weight = [summed.get(i, 0.0) + SMOOTHING for i in range(len(names) + 256)]
    total = math.log(sum(weight) + ends)
    logs = [math.log(w) - total for w in weight]
    return Pieces(dict(zip(names, logs)), tuple(logs[len(names) :]), math.log(ends) - total)


def _scored(counts: DataFrame, model: Pieces) -> DataFrame:
    """``(word, c, log)`` with the natural logarithm of each word's probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model)
        for batch in batches:
            logs = pa.array(list(lattice.all_logs(batch.column(0).to_pylist())), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), logs], ["word", "c", "log"])

    return counts.select("word", "c").mapInArrow(run, "word string, c bigint, log double")


def scores(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """``(key, held_out, n_tokens, n_known, train_tokens, base_score, score)``, logarithms to base 10."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), is_held_out(key).alias("out"))
    counts = written_once(word_counts(rows, F.col("out")))
    ends = rows.where(~F.col("out")).count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    total, distinct = sums["n"] + ends, sums["v"] + (ends > 0)
    model = fitted(counts, ends, read_pieces(path))
    top = C.most_frequent(counts, "every", hot)
    divisor = float(total + distinct + 1)
    often = {r["word"]: (r["c"] > 0, math.log10((r["c"] + 1) / divisor), r["log"] / math.log(10)) for r in _scored(top, model).collect()}
    # Words as bytes: a split of bytes is at space and U+0009 to U+000D, and their lower case changes A-Z alone.
    known = docs.sparkSession.sparkContext.broadcast(
        (
            {w.encode(): i for i, w in enumerate(often)},
            np.array([v for v in often.values()] or np.zeros((0, 3)), dtype="f8"),
        )
    )  # at most ``hot`` words
    end = np.array([ends > 0, math.log10((ends + 1) / divisor), model.end / math.log(10)], dtype="f8")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, told = known.value
        for batch in batches:
            words, sizes = [], []
            for value in batch.column(0):
                found = (value.as_py() or "").encode().lower().split()
                words += found
                sizes.append(len(found))
            at = np.repeat(np.arange(len(sizes)), sizes)
            place = np.fromiter(map(index.get, words, repeat(-1)), dtype="i4", count=len(words))
            usual = place >= 0
            rows = np.bincount(at[usual], minlength=len(sizes)) + 1
            sums = [np.bincount(at[usual], told[place[usual], i], len(sizes)) + end[i] for i in range(3)]
            rare = np.flatnonzero(~usual)
            m, k = len(rare), len(sizes)
            back = pa.array(np.append(at[rare], np.arange(k)).astype("i4"))
            text = pa.array([words[i] for i in rare.tolist()], pa.binary()).cast(pa.string())

            def of_heads(values: np.ndarray, kind: pa.DataType) -> pa.Array:
                return pa.concat_arrays([pa.nulls(m, kind), pa.array(values, kind)])

            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i).take(back) for i in (1, 2, 3)],
                    pa.concat_arrays([text, pa.nulls(k, pa.string())]),
                    pa.array(np.append(np.ones(m, "i8"), rows)),
                    of_heads(np.rint(sums[0]).astype("i8"), pa.int64()), of_heads(sums[1], pa.float64()), of_heads(sums[2], pa.float64()),
                ],
                ["id", "out", "row", "word", "n", "known", "base", "score"],
            )

    shape = rows.select("id", "out", F.xxhash64("text").alias("row")).schema
    told = rows.select("text", "id", "out", F.xxhash64("text").alias("row")).mapInArrow(
        split, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shape) + ", word string, n bigint, known bigint, base double, score double"
    )
    # A row without word has the sums of a document's frequent words. Its join key is no word, and spread.
    told = told.withColumn("by", F.coalesce("word", F.concat(F.lit(" "), F.xxhash64("id", "row").cast("string"))))
    words = _scored(counts, model).select(F.col("word").alias("by"), "c", "log")
    joined = told.join(words, "by", "left")
    rare = F.col("word").isNotNull()
    base = F.when(rare, F.col("n") * F.log10((F.col("c") + 1) / F.lit(divisor))).otherwise(F.col("base"))
    score = F.when(rare, F.col("n") * F.col("log") / math.log(10)).otherwise(F.col("score"))
    seen = F.when(rare, F.when(F.col("c") > 0, F.col("n")).otherwise(0)).otherwise(F.col("known"))
    per = joined.groupBy("id", "out", "row").agg(
        F.count(F.when(~rare, 1)).alias("times"), F.sum("n").alias("n"), F.sum(seen).alias("seen"),
        F.sum(base).alias("base"), F.sum(score).alias("score"),
    )
    # A row that stands in the input several times was summed as often.
    each = lambda name: (F.col(name) / F.col("times")).cast("bigint")
    return per.select(
        F.col("id").alias(key),
        F.col("out").alias("held_out"),
        each("n").alias("n_tokens"),
        each("seen").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") / F.col("times")).alias("base_score"),
        (F.col("score") / F.col("times")).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"),
    ).drop("copy")
