"""Quality classifier by Bradley-Terry ranking: a document's score is learned from preference pairs.

Each pair holds a document labelled good and one labelled bad. The chance that the good one is preferred is the
logistic function of the difference of their scores, so the weights minimise the logistic loss on differences of
features. Documents are accepted from a quantile of the scores on, the share of bad labels.

Features are shares and logarithms of counts of the text alone, built-in expressions over one row; scoring shuffles
nothing. The weights are fitted on at most ``SAMPLE`` labelled rows of each label, those first by hash, so the cost on the
driver is bounded. The bound is the exact quantile of the scores of all labelled rows that have a document; only their
ids and scores are shuffled.

Null texts count as empty and get a score like any text. Each input row gives one output row, repeated rows and null
ids included; further columns are not looked at. Label rows with null fields are left out; a document labelled twice
counts twice. Without both labels there are no pairs: all weights are 0 and every document is accepted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm import columns as C
from tributary.llm.quality_rules import STOP_WORDS
from tributary.operators import stats
from tributary.session import written_once

SAMPLE = 8_000
OPPONENTS = 8  # bad documents each good one meets, and the other way round


def features(text: Column, words: Column) -> dict[str, Column]:
    """The statistics a score is made of."""
    n = F.size(words)
    chars = F.char_length(text)
    unique = F.size(F.array_distinct(words))
    same = F.size(F.filter(F.transform(words, lambda w, i: w == F.get(words, i - 1)), lambda x: x))
    lines = F.size(F.split(text, "\n"))
    return {
        "log_words": F.log1p(n),
        "word_chars": C.share(chars, n) / 10,
        "symbols": C.share(C.count_of(text, "#*$%&|<>{}[]\\^~_=+@"), n),
        "shouts": C.share(C.count_of(text, "!"), n),
        "stops": C.share(C.count_of(text, ".,;:?"), n),
        "upper": C.share(C.count_of(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÇÈÉÊËÎÏÔÙÛÜÄÖÑÁÍÓÚ"), chars),
        "digits": C.share(C.count_of(text, "0123456789"), chars),
        "unique": C.share(unique, n),
        "neighbours": C.share(same, n),
        "function_words": C.share(F.size(F.filter(words, lambda x: x.isin(STOP_WORDS))), n),
        "lines": C.share(lines, n),
        "bars": C.share(F.size(F.filter(words, lambda x: x == "|")), n),
    }


def described(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the array of features of every text."""
    base = docs.select(F.col(key), C.whole(text).alias("t")).select(key, "t", C.words(F.col("t")).alias("w"))
    values = features(F.col("t"), F.col("w"))
    return base.select(key, F.array(*[v.cast("double") for v in values.values()]).alias("x"))


@dataclass(frozen=True)
class Ranking:
    """Weights of the features and the bound from which documents are accepted."""

    weights: tuple[float, ...]
    bound: float
    accept: float = 0.3

    def total(self, x: Column) -> Column:
        """The weighted sum of the features."""
        return sum((F.get(x, F.lit(i)) * w for i, w in enumerate(self.weights)), F.lit(0.0))

    def score(self, x: Column) -> Column:
        """0 to 1; ``accept`` at the bound."""
        return 1 / (1 + F.exp(-(self.total(x) - self.bound + float(np.log(self.accept / (1 - self.accept))))))


def fit_pairs(good: np.ndarray, bad: np.ndarray, opponents: int = OPPONENTS, penalty: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights that minimise the logistic loss on ``good - bad`` differences, by Newton steps."""
    scale = np.concatenate([good, bad]).std(axis=0)
    scale[scale == 0] = 1.0
    rng = np.random.default_rng(8)
    pairs = [(np.arange(len(good)), rng.integers(0, len(bad), len(good))) for _ in range(opponents)]
    pairs += [(rng.integers(0, len(good), len(bad)), np.arange(len(bad))) for _ in range(opponents)]
    i, j = (np.concatenate(side) for side in zip(*pairs))
    d = (good[i] - bad[j]) / scale
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = penalty * w - d.T @ p / len(d)
        curvature = (d * (p * (1 - p))[:, None]).T @ d / len(d) + penalty * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def quantile_bound(scores: np.ndarray, weights: np.ndarray, share: float) -> float:
    """The value with ``share`` of the weight below it, half-way between its neighbours."""
    order = np.argsort(scores, kind="stable")
    scores, below = scores[order], np.cumsum(weights[order])
    k = int(np.searchsorted(below, share * below[-1], side="left")) + 1
    k = min(max(k, 1), len(scores) - 1) if len(scores) > 1 else 0
    return float((scores[k - 1] + scores[k]) / 2) if k else float(scores[0])


def bound_of_all(scored: DataFrame) -> float:
    """The value with the share of rows labelled bad below it, half-way between its neighbours; ``scored`` has ``(y, s)``
    with both labels and is read several times."""
    counts = {r["y"]: r["n"] for r in scored.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    n = counts[0] + counts[1]
    around = [(counts[0] - 0.5) / n, (counts[0] + 0.5) / n]  # the ranks counts[0] - 1 and counts[0]
    rows = stats.order_statistics(scored.withColumn("g", F.lit(0)), "g", "s", around).collect()
    return sum(r["s"] for r in rows) / 2


def learning_rows(labels: DataFrame, key: str = "doc_id", folds: int = 5, held_out: int = 0) -> DataFrame:
    """Label rows that may be learned from."""
    return labels.where(F.crc32(F.col(key).cast("string").cast("binary")) % folds != held_out)


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> Ranking:
    """A ranking learned from the labelled documents; ``labels`` has the rows that may be learned from."""
    return fit_described(written_once(described(docs, key, text)), labels, sample, key, label)


def fit_described(found: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", label: str = "quality") -> Ranking:
    """The same from ``(key, x)`` of every document, which is read twice."""
    named = labels.select(F.col(key), F.col(label).cast("int").alias("y")).where(F.col(key).isNotNull() & F.col("y").isin(0, 1))
    totals = {r["y"]: r["n"] for r in named.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [
        named.where(F.col("y") == y).orderBy(F.xxhash64(key), key).limit(sample).collect() for y in (0, 1)
    ]
    rows = [tuple(r) for part in chosen for r in part]
    n = len(features(F.lit(""), F.array(F.lit(""))))
    if not rows or not totals.get(0) or not totals.get(1):
        return Ranking((0.0,) * n, 0.0)
    few = F.broadcast(found.sparkSession.createDataFrame(rows, named.schema))  # at most twice ``sample`` ids
    learned = sorted(found.join(few, key).select("y", "x").collect())  # pairs do not hang on the order of tasks
    y = np.array([r["y"] for r in learned])
    x = np.array([r["x"] for r in learned], dtype="float64").reshape(len(learned), n)
    if not (y == 0).any() or not (y == 1).any():
        return Ranking((0.0,) * n, 0.0)
    w = fit_pairs(x[y == 1], x[y == 0])
    weights = tuple(float(v) for v in w)
    totalled = found.select(key, Ranking(weights, 0.0).total(F.col("x")).alias("s"))
    bound = bound_of_all(written_once(totalled.join(named, key).select("y", "s")))
    return Ranking(weights, bound)


def ranked(docs: DataFrame, ranking: Ranking, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score, predicted)`` of every row."""
    return ranked_described(described(docs, key, text), ranking, key)


def ranked_described(found: DataFrame, ranking: Ranking, key: str = "doc_id") -> DataFrame:
    """The same from ``(key, x)`` of every document."""
    scored = found.select(key, ranking.score(F.col("x")).alias("score"))
    return scored.select(key, "score", (F.col("score") >= ranking.accept).cast("int").alias("predicted"))


def _with_features(docs: DataFrame, name: str, text: str) -> DataFrame:
    """``docs`` with the array of features of the text as a further column."""
    t = C.whole(text)
    made = C.let(C.words(t), lambda words: F.array(*[v.cast("double") for v in features(t, words).values()]))
    return docs.withColumn(name, made)


def accepted(docs: DataFrame, ranking: Ranking, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the ranking accepts, with all their columns."""
    made = _with_features(docs, "__features", text)
    return made.where(ranking.score(F.col("__features")) >= ranking.accept).drop("__features")


def accepted_by_labels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that a ranking accepts which was learned from them; each text is described once."""
    made = written_once(_with_features(docs, "__features", text))
    ranking = fit_described(made.select(key, F.col("__features").alias("x")), labels, key=key)
    return made.where(ranking.score(F.col("__features")) >= ranking.accept).drop("__features")
