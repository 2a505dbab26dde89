"""The pipeline stage by stage."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from tests.llm import helpers as H
from tests.llm.test_near_dup import _components
from tributary.llm import queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = H.corpus(spark), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name)
        stage(spark, docs, H.SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def _texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_names_and_columns(spark, steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "benchmark", "encoding"]
    for docs in steps[:-1]:
        assert docs.columns == COLUMNS and docs.dtypes == H.corpus(spark).dtypes
    assert all(len(_texts(a)) >= len(_texts(b)) for a, b in zip(steps[:-1], steps[1:-1]))


def test_quality_stage_drops_what_the_query_rejects(spark, steps):
    accepted = {r["doc_id"] for r in queries.op8_quality_ranking(spark, H.SF_DIR).where("predicted = 1").collect()}
    assert set(_texts(steps[0])) == accepted


def test_line_stage_leaves_texts_without_common_lines(spark, steps):
    before, after = _texts(steps[0]), _texts(steps[1])
    where = {}
    for r in steps[0].collect():
        for line in r["text"].split("\n"):
            if line.strip():
                where.setdefault(line.strip(" \t\n\x0b\x0c\r"), set()).add(r["source"])
    common = {x for x, sites in where.items() if len(sites) >= 5}
    assert all(after[k] == before[k] for k in after if not common & {x.strip(" \t\n\x0b\x0c\r") for x in before[k].split("\n")})
    seen = [x.strip(" \t\n\x0b\x0c\r") for t in after.values() for x in t.split("\n")]
    assert all(seen.count(x) <= 1 for x in common)
    assert all(r["n_chars"] == len(r["text"]) for r in steps[1].collect())


def test_copies_and_leaks_go(spark, steps):
    kept = {k for k, v in _components(_texts(steps[1]), corpus_pipeline.NEAR).items() if v[2]}
    assert set(_texts(steps[2])) == kept
    items = [r["text"] for r in H.corpus(spark, "benchmark").collect()]
    left = _texts(steps[3])
    assert not [k for k, t in left.items() if any(x in t for x in items)]
    gone = set(_texts(steps[2])) - set(left)
    assert len(gone) < 0.1 * len(kept)


def test_encoding_stage_and_run(spark, steps):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    texts = _texts(steps[3])
    rows = steps[4].collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    whole = entry_points.queries()["pipeline"](spark, H.SF_DIR)
    assert H.plain(whole.collect()) == H.plain(rows)


@pytest.mark.parametrize("rows", [0, 1])
def test_odd_documents(spark, rows, tmp_path):
    """No rows, or rows with null fields and further columns."""
    docs = H.odd(spark).withColumn("score", F.lit(1)) if rows else spark.createDataFrame([], H.DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        found = stage(spark, docs, H.SF_DIR)
        assert found.columns == docs.columns
        found.write.parquet(path)
        docs = spark.read.parquet(path)
    assert corpus_pipeline.encode(spark, docs, H.SF_DIR).count() == docs.count()


def test_entry_points():
    names = entry_points.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert set(entry_points.oracle_sql()) <= set(names)
