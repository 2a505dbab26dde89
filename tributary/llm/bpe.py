"""Byte-pair encoding and decoding with an existing vocabulary, and a lexicon of the corpus's frequent words.

Words of all documents are counted; the most frequent ones are encoded once and compiled into a shared-suffix
transducer (``lexicon``), a file that Spark hands to every executor and whose pages its workers share. Encoding looks
a word up there and merges words it does not hold by the vocabulary's merge ranks, with the same result, so the
lexicon changes speed only. Vocabulary files are given by path and have a fixed size.

The steps are those of the vocabulary file: added tokens first, then NFC, white space, lower case, the pattern that
cuts words, bytes as letters, merges. Files with other steps are refused. Decoding joins tokens by a space, which is
what a file without decoder asks for.

Null texts count as empty; an empty text has no ids and decodes to an empty text. Each input row gives one output
row, repeated rows and null ids included; further columns of the input are not looked at.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import struct
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm import characters, lexicon
from tributary.llm import columns as C
from tributary.session import written_once

FREQUENT = 100_000  # words in the lexicon at most
PART = 500  # texts that are encoded and decoded before they leave the worker
REMEMBERED = 50_000  # words besides the lexicon's whose ids a worker keeps at hand

# The supported files' pattern of words, and the same for sets of characters with letters first.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_RULE = r"[<L>]+|'(?:s|t|re|ve|m|ll|d)|[<N>]|[^<S><L><N>]+"
# Lower case of the letters that came with Unicode 16 and 17, for older tables.
_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
_LOWER |= {p: p + 0x20 for p in range(0x10D50, 0x10D66)} | {p: p + 0x1B for p in range(0x16EA0, 0x16EB9)}
_NEWER = re.compile(f"[{''.join(map(chr, _LOWER))}]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, others = [""] * 256, 0
    for byte in range(256):
        if byte in plain:
            letters[byte] = chr(byte)
        else:
            letters[byte] = chr(256 + others)
            others += 1
    return letters


def read_vocabulary(path: str) -> dict:
    """Plain data of a vocabulary file, checked to have the steps that are built here."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    model, steps = data["model"], data["pre_tokenizer"]["pretokenizers"]
    kinds = [s["type"] for s in data["normalizer"]["normalizers"]]
    told = (
        kinds == ["NFC", "Replace", "Lowercase"]
        and [s["type"] for s in steps] == ["Split", "ByteLevel"]
        and steps[0]["pattern"] == {"Regex": _PATTERN}
        and not steps[1]["add_prefix_space"]
        and data["decoder"] is None
        and model["end_of_word_suffix"] == "</w>"
        and not any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in data["added_tokens"])
    )
    if not told:
        raise ValueError(f"{path} has steps that are not supported")
    vocab, ends = model["vocab"], model["end_of_word_suffix"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return {
        "vocab": vocab,
        "letters": [vocab[letter] for letter in byte_letters()],
        "endings": [vocab[letter + ends] for letter in byte_letters()],
        "ranks": {vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in enumerate(merges)},
        "made": [vocab[a + b] for a, b in merges],
        "words": characters.patterns(_RULE),
        "added": {a["content"]: a["id"] for a in data["added_tokens"]},
    }


class Encoder:
    """Encodes and decodes in one process. ``words`` is a lexicon or None."""

    def __init__(self, data: dict, words: lexicon.Lexicon | None = None):
        self.added = data["added"]
        self.ranks, self.made, self.letters, self.endings = data["ranks"], data["made"], data["letters"], data["endings"]
        self.words = words
        self.find = [re.compile(rule).findall for rule in data["words"]]
        specials = "|".join(re.escape(a) for a in sorted(self.added, key=len, reverse=True))
        self.specials = re.compile(f"({specials})") if specials else None
        named = data["vocab"] | self.added
        self.tokens = [""] * (max(named.values()) + 1)
        for token, number in named.items():
            self.tokens[number] = token
        self.known = _Known(self)

    def pieces(self, text: str) -> list[str]:
        """The words of a text without added tokens."""
        if text.isascii():
            return self.find[0](text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # a letter's lower case does not hang on its place
        if _NEWER.search(text):
            text = text.translate(_LOWER)
        return self.find[characters.narrowest(text)](text)

    def merged(self, word: str) -> list[int]:
        """The ids of a word by merging the pair of lowest rank, the leftmost of equals, until none is left."""
        code = word.encode("utf-8", "replace")
        letters = self.letters
        symbols = [letters[b] for b in code]
        symbols[-1] = self.endings[code[-1]]
        if len(symbols) > 48:
            return self._long(symbols)
        rank, made, none = self.ranks.get, self.made, len(self.made)
        ranks = [rank(a << 32 | b, none) for a, b in zip(symbols, symbols[1:])]
        while ranks and (least := min(ranks)) < none:
            at = ranks.index(least)
            new = symbols[at] = made[least]
            del symbols[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(symbols[at - 1] << 32 | new, none)
            if at < len(ranks):
                ranks[at] = rank(new << 32 | symbols[at + 1], none)
        return symbols

    def _long(self, symbols: list[int]) -> list[int]:
        """The same for many symbols, with the pairs in a heap. A merged symbol's second place becomes -1."""
        n, rank, made = len(symbols), self.ranks.get, self.made
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            least, i = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] < 0 or rank(symbols[i] << 32 | symbols[j]) != least:
                continue
            symbols[i], symbols[j] = made[least], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) >= 0 and (r := rank(symbols[left] << 32 | symbols[right])) is not None:
                    heapq.heappush(heap, (r, left))
        return [s for s in symbols if s >= 0]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        known = self.known
        if self.specials is None or not any(a in text for a in self.added):
            return b"".join([known[w] for w in self.pieces(text)])
        out = []
        for part in self.specials.split(text):
            if part in self.added:
                out.append(np.uint32(self.added[part]).astype("<u4").tobytes())
            else:
                out.extend(known[w] for w in self.pieces(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


class _Known(dict):
    """Word to ids: the lexicon's words as they come, others while there is room."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder
        self.frequent: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= len(self.frequent) + REMEMBERED:
            self.clear()
            self.update(self.frequent)
        words = self.encoder.words
        ids = words.ids(word.encode("utf-8", "replace")) if words is not None else None
        if ids is None:
            ids = struct.pack(f"<{len(merged := self.encoder.merged(word))}I", *merged)
        else:
            self.frequent[word] = ids
        if len(word) <= 64:
            self[word] = ids
        return ids


class Vocabulary:
    """A vocabulary and its lexicon as tasks get them. Tasks of one worker share one encoder."""

    def __init__(self, data, file: str | None):
        self.data, self.file = data, file

    def encoder(self) -> Encoder:
        shared = self.data.value
        made = shared.get("encoder")
        if made is None or made[0] != self.file:
            words = lexicon.Lexicon(SparkFiles.get(self.file)) if self.file else None
            made = shared["encoder"] = (self.file, Encoder(shared, words))
        return made[1]


def _texts(batch: pa.RecordBatch, column: int = 1) -> Iterator[str]:
    for value in batch.column(column):
        yield value.as_py() or ""


def word_counts(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """``(word, n)`` over all documents, counted in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary.encoder().pieces
        counted: Counter = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(counted.keys(), pa.string()), pa.array(counted.values(), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for value in _texts(batch, 0):
                counted.update(pieces(value))
                if len(counted) > 200_000:
                    yield told()
                    counted.clear()
        yield told()

    found = docs.select(C.whole(text).alias("t")).mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def with_lexicon(docs: DataFrame, path: str, frequent: int = FREQUENT, text: str = "text") -> Vocabulary:
    """The vocabulary of ``path`` with a lexicon of at most ``frequent`` words, the most frequent of ``docs``."""
    context = docs.sparkSession.sparkContext
    plain = Vocabulary(context.broadcast(read_vocabulary(path)), None)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = plain.encoder().merged
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([merged(w) for w in words], pa.list_(pa.int32()))], ["word", "ids"]
            )

    counted = written_once(word_counts(docs, plain, text).where("n > 1 and length(word) <= 64"))
    top = C.most_frequent(counted, "n", frequent).select("word").mapInArrow(encode, "word string, ids array<int>")
    words = {r["word"]: r["ids"] for r in top.collect()}  # at most ``frequent`` words
    if not words:
        return plain
    name = f"lexicon-{uuid.uuid4().hex}"
    folder = os.path.join(SparkFiles.getRootDirectory(), "lexicons")  # of the session; Spark sends files from there
    os.makedirs(folder, exist_ok=True)
    file = os.path.join(folder, name)
    with open(file, "wb") as out:
        out.write(lexicon.compiled(words))
    context.addFile(file)
    return Vocabulary(plain.data, name)


def encoded(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids)``; ids as little-endian unsigned 32-bit integers, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary.encoder().encode
        for batch in batches:
            ids = pa.array([encode(t) for t in _texts(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [key, "ids"])

    rows = docs.select(F.col(key), C.whole(text).alias("t"))
    return rows.mapInArrow(run, rows.select(key, F.lit(b"").alias("ids")).schema)


def _tokens(coded: pa.Array, decode) -> pa.Array:
    return pa.array([decode(v.as_py() or b"") for v in coded], pa.string())


def decoded(coded: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, ids, text)``: the ids and their tokens joined by spaces. Null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = vocabulary.encoder().decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _tokens(batch.column(1), decode)], [key, "ids", "text"])

    rows = coded.select(F.col(key), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, rows.select("*", F.lit("").alias("text")).schema)


def round_trip(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids, text)``, encoded and decoded again in one worker a task: two workers would hold two encoders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                ids = pa.array([encoder.encode(t) for t in _texts(part)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, _tokens(ids, encoder.decode)], [key, "ids", "text"])

    rows = docs.select(F.col(key), C.whole(text).alias("t"))
    return rows.mapInArrow(run, rows.select(key, F.lit(b"").alias("ids"), F.lit("").alias("text")).schema)


def digests(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)`` of every row, encoded and decoded again."""
    return round_trip(docs, vocabulary, key, text).select(
        key,
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
