"""Lattice sums against listed segmentations, the query against plain Python."""

import math
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import helpers as H
from tributary.llm import lattice_lm as L
from tributary.llm import queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


def _segmentations(model, text):
    if not text:
        yield 0.0, []
        return
    spelled = sum(model.bytes[b] for b in text[0].encode())
    ways = [(text[:n], model.pieces[text[:n]]) for n in range(1, len(text) + 1) if text[:n] in model.pieces]
    if text[0] not in model.pieces:
        ways.append((text[0], spelled))
    for part, value in ways:
        for rest, parts in _segmentations(model, text[len(part) :]):
            yield value + rest, [part, *parts]


@pytest.fixture(scope="module")
def model():
    return L.read_pieces(PATH)


def test_weights_are_probabilities(model):
    total = sum(map(math.exp, model.pieces.values())) + sum(map(math.exp, model.bytes)) + math.exp(model.end)
    assert total == pytest.approx(1)


@pytest.mark.parametrize("word", ["the", "nation", "thhaen", "étion", "日x\U0001f600", "a1!b", "\x00"])
@pytest.mark.parametrize("short", [40, 0])
def test_sums_over_all_segmentations(model, word, short, monkeypatch):
    lattice = L.Lattice(model)
    words = sorted([word, word + "x", word[:1], "the", "then", "theory"])
    assert list(lattice.all_logs(words)) == [L.Lattice(model).log(w) for w in words]
    listed = list(_segmentations(model, "▁" + word))
    total = math.fsum(math.exp(v) for v, _ in listed)
    assert lattice.log(word) == pytest.approx(math.log(total))
    monkeypatch.setattr(L, "SHORT", short)
    pieces, spelled = L.Lattice(model).expected([(word, 1.0), (word, 2.0)])
    where = {p: i for i, p in enumerate(model.pieces)}
    want = Counter()
    for value, parts in listed:
        for part in parts:
            want[part] += 3 * math.exp(value) / total
    for part, n in want.items():
        if part in model.pieces:
            assert pieces[where[part]] == pytest.approx(n)
        else:
            assert all(spelled[b] > 0 for b in part.encode())


def test_query_matches_plain_python(spark):
    texts = H.texts(spark)
    words = {k: re.findall("[^\x20\x09-\x0d]+", t.translate(H.LOWER)) + [None] for k, t in texts.items()}
    out = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    c = Counter(w for k, ws in words.items() if not out[k] for w in ws)
    n, v = sum(c.values()), len(c)
    docs = H.corpus(spark)
    rows = queries.op7_lattice_lm(spark, H.SF_DIR).collect()
    few = L.scores(docs, PATH, hot=10).collect()  # nearly all words take the join
    assert len(rows) == len(few) == len(texts)
    of_few = {r["doc_id"]: r for r in few}
    model = L.fitted(L.word_counts(docs, L.is_held_out("doc_id")), c[None], L.read_pieces(PATH))
    lattice = L.Lattice(model)
    for r in rows:
        ws = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (out[r["doc_id"]], len(ws), n)
        assert r["n_known"] == sum(c[w] > 0 for w in ws)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        other = of_few[r["doc_id"]]
        assert (r["n_known"], r["base_score"], r["score"]) == pytest.approx((other["n_known"], other["base_score"], other["score"]))
        if r["n_tokens"] < 120:
            logs = model.end + math.fsum(lattice.log(w) for w in ws[:-1])
            assert r["score"] == pytest.approx(logs / math.log(10))


def test_learning_helps_held_out_texts(spark):
    docs = H.corpus(spark)
    start = L.read_pieces(PATH)
    learned = L.fitted(L.word_counts(docs, L.is_held_out("doc_id")), docs.where(~L.is_held_out("doc_id")).count(), start)
    words = [w for r in docs.where(L.is_held_out("doc_id")).collect() for w in H.WORD.findall(r["text"].translate(H.LOWER))]
    assert sum(map(L.Lattice(learned).log, words)) > sum(map(L.Lattice(start).log, words))


def test_no_training_documents(spark):
    docs = spark.createDataFrame([(i, "one two") for i in range(200)], "doc_id bigint, text string").where(L.is_held_out("doc_id"))
    rows = L.scores(docs, PATH).collect()
    assert rows and all((r["n_known"], r["train_tokens"]) == (0, 0) and math.isfinite(r["score"]) for r in rows)


def test_repeated_rows_are_scored_each(spark):
    one = spark.createDataFrame([(1, "aa bb aa"), (4, "cc")], "doc_id bigint, text string")
    both = one.unionByName(one.where("doc_id = 1"))
    rows = L.scores(both, PATH, hot=1).where(F.col("doc_id") == 1).collect()
    assert [r["n_tokens"] for r in rows] == [4, 4] and rows[0]["score"] == rows[1]["score"]
