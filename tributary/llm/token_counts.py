"""How many tokens a byte-level vocabulary makes of each text, without making their ids.

A text is cut into words by the vocabulary's pattern. A word begins as its UTF-8 bytes in a linked list; the adjacent
pairs that have a rank lie in a heap, the pair of lowest rank (the leftmost of equals) is popped and merged, and its
two new neighbours are pushed. The word's count is its bytes less its merges. Entries whose pair has changed since are
passed over when popped, so a word of n bytes takes about n log n steps however long it is. Counts of words are kept at
hand within a worker, up to ``REMEMBERED``; that changes speed only.

Strings of the file's special tokens inside a text count as one token each, which is the library's default. Files with
steps other than those built here are refused. There is no shuffle: each row is counted where it is read.

Null texts count as empty; an empty text has no bytes and no tokens. Each input row gives one output row, repeated
rows and null ids included; further columns of the input are not looked at. An empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import characters
from tributary.llm import columns as C
from tributary.llm.bpe import byte_letters

LIMIT = 512  # tokens of a text that is not over the limit
REMEMBERED = 400_000  # words whose counts a worker keeps at hand
WHOLE = 1 << 20  # characters from which on a text's words are not listed at once

# The pattern that byte-level vocabularies name by ``use_regex``. Words of letters begin it, since no other
# alternative begins with a letter.
_RULE = r" ?[<L>]+|'(?:s|t|re|ve|m|ll|d)| ?[<N>]+| ?[^<S><L><N>]+|[<S>]+(?![^<S>])|[<S>]+"


def read_vocabulary(path: str) -> dict:
    """The ranks of pairs, the special strings and the patterns of words of a vocabulary file, as plain data.

    Symbols are numbered: bytes 0 to 255 first, then what merges make. ``ranks`` has ``pair -> (rank, symbol)`` with a
    pair as ``left << 32 | right``.
    """
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    model, cut = data["model"], data["pre_tokenizer"]
    told = (
        data["normalizer"] is None
        and data["post_processor"] is None
        and cut["type"] == "ByteLevel"
        and cut["use_regex"]
        and not cut["add_prefix_space"]
        and model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and not any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in data["added_tokens"])
        and all(letter in model["vocab"] for letter in byte_letters())
    )
    if not told:
        raise ValueError(f"{path} has steps that are not supported")
    symbols = {letter: byte for byte, letter in enumerate(byte_letters())}
    ranks = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        made = symbols.setdefault(left + right, len(symbols))
        ranks[symbols[left] << 32 | symbols[right]] = (rank, made)
    return {"ranks": ranks, "special": [a["content"] for a in data["added_tokens"]], "words": characters.patterns(_RULE)}


class Counter:
    """Counts tokens in one process."""

    def __init__(self, data: dict):
        self.ranks = data["ranks"]
        self.find = [re.compile(rule) for rule in data["words"]]
        special = sorted(data["special"], key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.known = _Known(self)

    def merged(self, word: bytes) -> int:
        """The number of tokens of a word: its bytes less the merges that its heap of pairs allows."""
        n = left = len(word)
        ranks, symbols = self.ranks, list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = ranks.get(symbols[i] << 32 | symbols[i + 1])
            if found is not None:
                heap.append(found[0] * n + i)
        heapq.heapify(heap)
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            if j >= n or symbols[i] < 0:
                continue
            found = ranks.get(symbols[i] << 32 | symbols[j])
            if found is None or found[0] != rank:  # the pair has changed since it was pushed
                continue
            symbols[i], symbols[j] = found[1], -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (new := ranks.get(symbols[i] << 32 | symbols[k])) is not None:
                    heapq.heappush(heap, new[0] * n + i)
            if (h := before[i]) >= 0 and (new := ranks.get(symbols[h] << 32 | symbols[i])) is not None:
                heapq.heappush(heap, new[0] * n + h)
        return left

    def _plain(self, text: str) -> int:
        find, known = self.find[characters.narrowest(text)], self.known
        if len(text) < WHOLE:
            return sum(map(known.__getitem__, find.findall(text)))
        return sum(known[m[0]] for m in find.finditer(text))

    def count(self, text: str) -> int:
        if self.special is None or self.special.search(text) is None:
            return self._plain(text)
        return len(self.special.findall(text)) + sum(map(self._plain, self.special.split(text)))


class _Known(dict):
    """Word to count, remembered while there is room."""

    def __init__(self, counter: Counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> int:
        n = self.counter.merged(word.encode("utf-8", "replace"))
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


def token_column(spark: SparkSession, path: str) -> Callable[[Column], Column]:
    """A function from a text column to its number of tokens, one call per Arrow batch."""
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))  # a file of fixed size

    @F.pandas_udf("bigint")
    def tokens(batch: pd.Series) -> pd.Series:
        count = _shared(vocabulary.value).count
        return pd.Series([count(t or "") for t in batch], dtype="int64")

    return tokens


def _shared(data: dict) -> Counter:
    """The counter of this worker, which its later tasks find."""
    if "counter" not in data:
        data["counter"] = Counter(data)
    return data["counter"]


def counted(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` of every row by the vocabulary file at ``path``."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))  # a file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _shared(vocabulary.value).count
        for batch in batches:
            texts = batch.column(1)
            tokens = pa.array([count(t.as_py()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts).cast(pa.int64()), tokens], [key, "n_bytes", "n_tokens"]
            )

    rows = docs.select(F.col(key), C.whole(text).alias("t"))
    schema = rows.select(key, F.lit(0).cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_tokens")).schema
    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
