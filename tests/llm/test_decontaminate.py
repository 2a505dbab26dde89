"""Leaks in the corpus and made ones, against brute force."""

import random

import numpy as np

from tests.llm import helpers as H
from tributary.llm import decontaminate as X
from tributary.llm import license_scan, queries


def _words(text):
    return license_scan.template_words(text or "")


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], max(row[j + 1], row[j], last + 1 if x == y else 0)
    return row[-1]


def test_bit_parallel_length():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.randrange(5) for _ in range(rng.randint(1, 70))]
        b = [rng.randrange(6) for _ in range(rng.randint(0, 90))]
        assert X.lcs(X.Item(None, tuple(a)).masks(), len(a), b) == _lcs(a, b)


def test_every_exact_passage_is_found_and_nothing_else(spark):
    texts = {k: _words(t) for k, t in H.texts(spark).items()}
    items = {r["item_id"]: _words(r["text"]) for r in H.corpus(spark, "benchmark").collect()}
    found = {(r["doc_id"], r["item_id"]): r["share"] for r in queries.op5_decontamination(spark, H.SF_DIR).collect()}
    likely = set()
    for d, text in texts.items():
        for i, item in items.items():
            n = len(item)
            if any(_lcs(item, text[max(0, a - n) : a + 2 * n]) >= X.SURE * n for a in range(0, len(text), n)):
                likely.add((d, i))
    assert likely and likely <= set(found)
    for d, i in set(found) - likely:
        assert found[d, i] >= X.LIKELY


def test_paraphrases_and_recall(spark):
    rng = random.Random(3)
    items = [(i, H.prose(500 + i, rng.randint(14, 60))) for i in range(60)]
    docs, want = [], set()
    for i, text in items:
        words = text.split()
        changed = list(words)
        for at in rng.sample(range(len(words) - X.ANSWER), len(words) // 5):
            changed[at] = f"other{at}"
        docs.append((2 * i, H.prose(900 + i, 300) + " " + " ".join(changed) + " " + H.prose(1900 + i, 200)))
        docs.append((2 * i + 1, H.prose(2900 + i, 500)))
        want.add((2 * i, i))
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in X.leaks(docs, benchmark).collect()}
    assert len(found & want) >= 0.95 * len(want) and not found - want
    clean = {r["doc_id"] for r in X.without_leaks(docs, benchmark).collect()}
    assert clean == {d for d in range(120)} - {d for d, _ in found}


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    whole = H.plain(queries.op5_decontamination(spark, H.SF_DIR).collect())
    monkeypatch.setattr(X, "ITEM_WORDS", 300)
    assert H.plain(queries.op5_decontamination(spark, H.SF_DIR).collect()) == whole


def test_latent_space_spans_the_strongest_directions(spark):
    rng = np.random.default_rng(1)
    codes = [[int(x) for x in rng.choice(40, 32, p=None) + 64 * (i % 3)] for i in range(300)]
    coded = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "id bigint, w array<int>").select("id", "w")
    coded = coded.select("id", coded["w"].cast("array<int>").alias("w"))
    idf = X.inverse_frequencies(coded)
    space = X.latent_space(coded, idf, rank=16)
    found = X.cut(np.array(sum(codes, []), "i4"), np.arange(0, 32 * 300 + 1, 32), idf)
    vectors = X._window_sums(found, space)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    alike = vectors @ vectors.T
    same = np.equal.outer(found.owner % 3, found.owner % 3)
    assert alike[same].mean() > alike[~same].mean() + 0.05


def _planted(seed, sizes, changed):
    """Items, documents that hold one each with a share of its words replaced and its answer kept, and the pairs."""
    rng, items, docs = random.Random(seed), [], []
    for i, n in enumerate(sizes):
        words = H.prose(7000 + 100 * seed + i, n).split()
        items.append((i, " ".join(words)))
        for at in rng.sample(range(max(0, n - X.ANSWER)), int(n * changed)):
            words[at] = f"other{at}"
        docs.append((i, H.prose(20_000 + 100 * seed + i, 300) + " " + " ".join(words) + " " + H.prose(30_000 + 100 * seed + i, 200)))
    return items, docs


def _pairs(spark, items, docs, **more):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]) for r in X.leaks(docs, benchmark, **more).collect()}


def test_every_item_with_its_answer_is_found_with_two_fifths_replaced(spark):
    rng = random.Random(8)
    items, docs = _planted(1, [rng.randint(15, 60) for _ in range(80)], 0.4)
    assert {(i, i) for i, _ in items} <= _pairs(spark, items, docs)


def test_short_exact_passages_are_found_without_a_cosine(spark):
    items, docs = _planted(2, [4, 5, 6, 7, 8, 9, 10, 12] * 5, 0.0)
    assert {(i, i) for i, _ in items} <= _pairs(spark, items, docs, cosine=2.0)  # no window reaches it
