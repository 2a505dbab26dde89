"""Quality rules against plain Python; the ranking on held-out labels."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm import helpers as H
from tributary.llm import queries, quality_ranking, quality_rules


def _expected(text):
    words = H.WORD.findall(text)
    triples = list(zip(words, words[1:], words[2:]))
    times, covered = Counter(triples), set()
    for i, t in enumerate(triples):
        if times[t] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in text.split("\n") if H.WORD.search(x)]
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": n < 50 or 100 * len(covered) > 50 * n,
    }


def test_base_counts_match_plain_python(spark):
    rows = queries.op2_quality_rules(spark, H.SF_DIR).collect()
    texts = H.texts(spark)
    assert len(rows) == len(texts)
    for r in rows:
        want = _expected(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want
        assert not (r["base_failed"] and r["kept"])
        assert r["kept"] == (not r["base_failed"] and r["failed"] == "")


def test_rules_run_without_user_functions_or_shuffles(spark):
    plan = queries.op2_quality_rules(spark, H.SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_the_table_of_rules_decides(spark):
    docs = spark.createDataFrame([(1, "the " + H.prose(5, 80)), (2, "the " + H.prose(6, 80) + " #" * 40)], "doc_id bigint, text string")
    rules = (quality_rules.Rule("symbols_per_word", 0.0, 0.1),)
    kept = {r["doc_id"]: (r["kept"], r["failed"]) for r in quality_rules.judge(docs, rules).collect()}
    assert kept == {1: (True, []), 2: (False, ["symbols_per_word"])}
    assert all(r["kept"] for r in quality_rules.judge(docs, ()).collect())


def test_ranking_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.op8_quality_ranking(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) > 40
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.95
    good = [r["score"] for r in rows if labels[r["doc_id"]] == 1]
    bad = [r["score"] for r in rows if labels[r["doc_id"]] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_pairs_recover_an_order():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 3))
    y = x @ np.array([2.0, -1.0, 0.0]) + rng.standard_normal(400) * 0.1 > 0
    w = quality_ranking.fit_pairs(x[y], x[~y])
    assert w[0] > 0 > w[1] and abs(w[2]) < 0.3 * w[0]
    assert quality_ranking.quantile_bound(np.array([1.0, 2.0, 3.0, 4.0]), np.ones(4), 0.5) == 2.5


def test_weights_and_scores_in_plain_numpy(spark):
    """The gradient of the mean logistic loss over the pairs is 0 at the weights; scores are the logistic function."""
    docs = H.corpus(spark, "documents")
    labels = H.corpus(spark, "labels").where("quality in (0, 1)")
    found = {r["doc_id"]: r["x"] for r in quality_ranking.described(docs).collect()}
    rows = sorted((r["quality"], found[r["doc_id"]]) for r in labels.collect() if r["doc_id"] in found)
    y, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    ranking = quality_ranking.fit(docs, labels)
    good, bad = x[y == 1], x[y == 0]
    scale = np.concatenate([good, bad]).std(axis=0)
    scale[scale == 0] = 1
    rng = np.random.default_rng(8)
    pairs = [(g, bad[k]) for _ in range(quality_ranking.OPPONENTS) for g, k in zip(good, rng.integers(0, len(bad), len(good)))]
    pairs += [(good[k], b) for _ in range(quality_ranking.OPPONENTS) for b, k in zip(bad, rng.integers(0, len(good), len(bad)))]
    w = np.array(ranking.weights) * scale
    gradient = 1e-2 * w
    for g, b in pairs:
        d = (g - b) / scale
        gradient = gradient - d / (1 + np.exp(d @ w)) / len(pairs)
    assert np.abs(gradient).max() < 1e-4
    totals = np.sort(x @ np.array(ranking.weights))
    assert np.isclose(ranking.bound, (totals[len(bad) - 1] + totals[len(bad)]) / 2)
    for r in quality_ranking.ranked(docs, ranking).collect():
        want = 1 / (1 + np.exp(-(np.dot(found[r["doc_id"]], ranking.weights) - ranking.bound + np.log(0.3 / 0.7))))
        assert np.isclose(r["score"], want) and r["predicted"] == int(r["score"] >= 0.3)


def test_held_out_rows_are_not_learned_from(spark):
    labels = H.corpus(spark, "labels")
    used = quality_ranking.learning_rows(labels)
    assert used.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).count() == 0
    assert 0 < used.count() < labels.count()


def test_the_bound_covers_all_labelled_rows(spark):
    """Also where the weights are fitted on a few of them."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    ranking = quality_ranking.fit(docs, labels, sample=20)
    scored = quality_ranking.described(docs).select("doc_id", ranking.total(F.col("x")).alias("s")).join(labels, "doc_id")
    rows = scored.select("s", "quality").collect()
    scores, bad = sorted(r["s"] for r in rows), sum(r["quality"] == 0 for r in rows)
    assert len(rows) > 40 and 0 < bad < len(rows)
    assert ranking.bound == (scores[bad - 1] + scores[bad]) / 2
