"""Components against brute force, on the corpus and on groups made to be hard."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import helpers as H
from tributary.llm import components, near_dup, queries


def _set(text):
    words = H.WORD.findall((text or "").translate(H.LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def _components(texts, least=85):
    sets = {k: _set(t) for k, t in texts.items()}
    over = {k: k for k in sets}

    def of(x):
        while over[x] != x:
            x = over[x]
        return x

    where = {}
    for k, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(k)
    for k, s in sets.items():
        shared = Counter(o for x in s for o in where[x] if o < k)
        for o, both in shared.items():
            if 100 * both >= least * (len(s) + len(sets[o]) - both):
                a, b = of(k), of(o)
                over[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), of(k), of(k) == k) for k in sets}


def _found(rows):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}


def _changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
    return " ".join(words)


def test_query_matches_brute_force(spark):
    assert _found(queries.op10_near_dup(spark, H.SF_DIR).collect()) == _components(H.texts(spark))


@pytest.fixture(scope="module")
def hard():
    """A large group around one original, chains, copies, and texts that share much but not enough."""
    rng = random.Random(4)
    texts, next_id = {}, iter(range(10_000))
    original = H.prose(11, 220).split()
    for _ in range(420):
        texts[next(next_id)] = _changed(rng, original, rng.randint(1, 4))
    for seed in range(20, 40):  # chains: each text from the one before
        words = H.prose(seed, 150).split()
        for _ in range(rng.randint(2, 6)):
            words = _changed(rng, words, 2).split()
            texts[next(next_id)] = " ".join(words)
    boiler = H.prose(50, 120)
    for seed in range(60, 160):  # common passage, own end
        texts[next(next_id)] = boiler + " " + H.prose(seed, rng.randint(20, 60))
    for seed in range(200, 230):
        for _ in range(rng.randint(1, 4)):
            texts[next(next_id)] = H.prose(seed, 40)
    texts[next(next_id)] = "two words"
    texts[next(next_id)] = "Two  WORDS"
    return texts


def test_hard_groups_match_brute_force(spark, hard):
    docs = spark.createDataFrame(list(hard.items()), "doc_id bigint, text string")
    assert _found(near_dup.near_duplicates(docs).collect()) == _components(hard)


def test_blocks_of_large_clusters_match_brute_force(spark, hard):
    docs = spark.createDataFrame(list(hard.items()), "doc_id bigint, text string").repartition(8)
    signed = near_dup.signatures(docs, "doc_id", "text").where("n_shingles > 0")
    classes = signed.groupBy("k1", "k2", "n_shingles").agg(
        F.min("id").alias("c"), F.any_value("tokens").alias("tokens"), F.any_value("bits").alias("bits")
    ).cache()
    everything = classes.select("c", F.lit(0).cast("bigint").alias("cluster"))  # one cluster with all texts
    links = near_dup.confirmed_links(docs, classes, everything, "doc_id", "text", group=50)
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    want = _components(hard)
    for r in classes.select("c").collect():
        assert got.get(r["c"], r["c"]) == want[r["c"]][1]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 300)]
    star = [(1000, 1000 + i) for i in range(1, 500)]
    links = spark.createDataFrame(chain + star + [(7, 7)], "u bigint, v bigint")
    found = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert found == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(500)}}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    minwise = near_dup.Minwise()
    shared = rng.integers(0, 2**64, 900, dtype="u8")
    agree = [
        int((minwise(np.append(shared, rng.integers(0, 2**64, 80, dtype="u8"))) == minwise(np.append(shared, rng.integers(0, 2**64, 79, dtype="u8")))).sum())
        for _ in range(50)
    ]
    assert abs(np.mean(agree) / near_dup.TOKENS - 0.85) < 0.03 and min(agree) > near_dup.LIKE


def test_kept_rows(spark, hard):
    docs = spark.createDataFrame(list(hard.items()), "doc_id bigint, text string").withColumn("more", F.lit(1))
    kept = near_dup.without_copies(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, v in _components(hard).items() if v[2]}


def _pairs_at(similarities, n=200):
    """Pairs of texts of ``n`` shingles each, of which as many differ as the similarity asks for."""
    texts = {}
    for i, share in enumerate(similarities):
        words = H.prose(4000 + i, n + 4).split()
        apart = round(n * (1 - share) / (1 + share))  # shingles of each text that the other has not
        texts[2 * i] = " ".join(words)
        texts[2 * i + 1] = " ".join(words[: n + 4 - apart] + [f"y{i}x{j}" for j in range(apart)])
    return texts


def test_the_stage_takes_similarities_from_80_on_and_the_query_from_85(spark):
    texts = _pairs_at([0.76, 0.78, 0.805, 0.81, 0.82, 0.83, 0.84, 0.86, 0.9] * 4)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    sets = {k: _set(t) for k, t in texts.items()}

    def kept(least):
        return {k for k in texts if k % 2 == 0 or 100 * len(sets[k] & sets[k - 1]) < least * len(sets[k] | sets[k - 1])}

    assert len(kept(85)) - len(kept(80)) == 20
    assert {r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, docs, H.SF_DIR).collect()} == kept(80)
    assert {r["doc_id"] for r in near_dup.without_copies(docs).collect()} == kept(85)


def test_bounds_follow_the_least_similarity():
    assert (near_dup.LIKE, near_dup.CLOSE, near_dup.TREES) == (38, 44, 4)
    assert (near_dup.alike_from(80), near_dup.leaves_from(80), near_dup.trees_for(80)) == (32, 40, 5)


def test_a_family_that_is_alike_but_not_linked_is_not_paired_up(spark):
    """2,000 pages of similarity 0.75 around one template, some of them edited a little: pairs to compare are about the links."""
    common, texts = H.prose(70, 175).split(), {}
    for i in range(2000):
        own = [f"p{i}w{j}" for j in range(29)]
        texts[i] = " ".join(common + own)
        if i % 50 == 0:  # one word of its own changed
            texts[5000 + i] = " ".join(common + own[:20] + ["edited"] + own[21:])
    assert 0.74 < len(_set(texts[1]) & _set(texts[2])) / len(_set(texts[1]) | _set(texts[2])) < 0.76
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(8).cache()
    found = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert found == {k: k - 5000 if k >= 5000 else k for k in texts}

    sets = docs.rdd.map(lambda r: (0, len(texts), r["doc_id"], r["doc_id"], bytearray(near_dup.shingles(np.array([zlib.crc32(w.encode()) for w in r["text"].split()], "u8")).tobytes())))
    members = spark.createDataFrame(sets, "cluster bigint, size bigint, c bigint, star bigint, set binary")
    pairs = {(r["u"], r["v"]) for r in near_dup.close_pairs(members).collect()}
    assert {(k - 5000, k) for k in texts if k >= 5000} <= pairs and len(pairs) < len(texts)


def test_close_pairs_in_pieces_lose_none(spark, hard, monkeypatch):
    rows = [(0, len(hard), k, k, near_dup.shingles(np.array([zlib.crc32(w.encode()) for w in t.lower().split()], "u8")).tobytes()) for k, t in hard.items()]
    members = spark.createDataFrame([(a, b, c, d, bytearray(e)) for a, b, c, d, e in rows], "cluster bigint, size bigint, c bigint, star bigint, set binary")
    whole = {(r["u"], r["v"]) for r in near_dup.close_pairs(members).collect()}
    monkeypatch.setattr(near_dup, "BLOCK", 40)
    monkeypatch.setattr(near_dup, "SLICE", 100)
    assert {(r["u"], r["v"]) for r in near_dup.close_pairs(members).collect()} == whole
    sets = {k: np.frombuffer(e, "u8") for _, _, k, _, e in rows}
    keys = sorted(sets)
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if near_dup._linked(sets[a], sets[b], 85)}
    assert want <= whole
