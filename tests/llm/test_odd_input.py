"""Every operator on null fields, empty and long texts, repeated rows, empty tables and clashing column names."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import helpers as H
from tributary.llm import bpe, decontaminate, lattice_lm, license_scan, line_dedup, near_dup, private_data, quality_ranking, quality_rules, token_counts


def _labels(spark, docs):
    return docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))


def _benchmark(spark):
    return spark.createDataFrame([(1, H.prose(2, 40)), (1, H.prose(2, 40)), (2, None), (3, ""), (None, H.prose(9, 20))], "item_id bigint, text string")


OPERATORS = {
    "rules": lambda s, d: quality_rules.judge(d),
    "licenses": lambda s, d: license_scan.scan(d),
    "lines": lambda s, d: line_dedup.without_boilerplate(d, sites=2),
    "leaks": lambda s, d: decontaminate.leaks(d, _benchmark(s)),
    "bpe": lambda s, d: bpe.digests(d, bpe.with_lexicon(d, public_tokenizers.path("word_bpe_49k.json"), 500)),
    "lm": lambda s, d: lattice_lm.scores(d, public_tokenizers.path("piece_bpe_32k.model"), hot=20),
    "ranking": lambda s, d: quality_ranking.ranked(d, quality_ranking.fit(d, _labels(s, d))),
    "accepted": lambda s, d: quality_ranking.accepted(d, quality_ranking.fit(d, _labels(s, d))),
    "private": lambda s, d: private_data.find(d),
    "masked": lambda s, d: private_data.masked(d),
    "near": lambda s, d: near_dup.near_duplicates(d),
    "counts": lambda s, d: token_counts.counted(d, public_tokenizers.path("byte_bpe_50k.json")),
    "copies": lambda s, d: near_dup.without_copies(d),
}
ROW_BY_ROW = ["rules", "lines", "bpe", "lm", "ranking", "private", "masked", "near", "counts"]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    docs = spark.createDataFrame([], H.DOCS)
    assert OPERATORS[name](spark, docs).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(spark, name):
    docs = H.odd(spark)
    found = OPERATORS[name](spark, docs)
    rows = found.collect()
    if name in ROW_BY_ROW:
        assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in H.odd_rows())
    again = OPERATORS[name](spark, H.wide(docs)).select(found.columns).collect()
    if name not in ("lm", "ranking"):  # sums of floating-point numbers may differ in their last place
        assert H.plain(rows) == H.plain(again)


def test_defined_results_of_empty_texts(spark):
    docs = H.odd(spark).where("doc_id in (1, 2, 3)")
    for r in quality_rules.judge(docs).collect():
        assert (r["n_words"], r["base_failed"], r["kept"]) == (0, True, False)
    for r in license_scan.scan(docs).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == (0, 0, None, None, "", "", 0.0)
    for r in private_data.find(docs).collect():
        assert r["base"] == [] and r["added"] == []
    for r in near_dup.near_duplicates(docs).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (0, r["doc_id"], True)
    vocabulary = bpe.with_lexicon(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert {r["n_tokens"] for r in bpe.digests(docs, vocabulary).collect()} == {0}
    for r in token_counts.counted(docs, public_tokenizers.path("byte_bpe_50k.json")).collect():
        assert (r["n_bytes"] > 0, r["n_tokens"] > 0, r["over_limit"]) == (r["doc_id"] == 3, r["doc_id"] == 3, False)
    for r in lattice_lm.scores(docs, public_tokenizers.path("piece_bpe_32k.model")).collect():
        assert r["n_tokens"] == 1
    for r in quality_ranking.ranked(docs, quality_ranking.fit(docs, _labels(spark, docs).limit(0))).collect():
        assert r["predicted"] == 1


def test_repeated_rows_and_ids(spark):
    found = {}
    for r in near_dup.near_duplicates(H.odd(spark)).collect():
        found.setdefault(r["doc_id"], set()).add((r["component_id"], r["kept"]))
    assert found[5] == {(5, True)} and found[6] == {(5, False)}
    assert found[None] == {(None, True)}
    assert found[7] == {(7, True)}
    licences = license_scan.scan(H.odd(spark)).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in licences}[5] == 1  # rows alike in id and text are one
