import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import tuples
from tributary.operators import embedding, ivf, knn, prompts, stats

RNG = np.random.default_rng(3)


def frame(spark, vectors, key="id", ids=None):
    ids = ids if ids is not None else range(len(vectors))
    kind = "string" if isinstance(next(iter(ids)), str) else "bigint"
    rows = [(i, [float(x) for x in v]) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, f"{key} {kind}, emb array<float>")


def brute(corpus, queries, k, ids=None):
    ids = list(ids) if ids is not None else list(range(len(corpus)))

    def unit(m):
        m = np.asarray(m, dtype="float32").astype("float64")
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    out = []
    for q, row in enumerate(np.round(1 - unit(queries) @ unit(corpus).T, 6) + 0.0):
        best = sorted(zip(row, ids))[:k]
        out += [(q, i, d, r) for r, (d, i) in enumerate(best, start=1)]
    return out


def hits(df):
    return [tuple(r) for r in df.select("query_id", "id", "dist", "rank").orderBy("query_id", "rank").collect()]


@pytest.fixture(scope="module")
def corpus():
    """Vectors with exact copies, zero rows, and one tight cluster that holds a third of them."""
    spread = RNG.normal(size=(300, 8))
    hot = RNG.normal(size=8) + 0.01 * RNG.normal(size=(200, 8))
    return np.vstack([spread, hot, spread[:60], np.zeros((40, 8))])


@pytest.fixture(scope="module")
def queries(corpus):
    return np.vstack([corpus[:5], corpus[305:308], RNG.normal(size=(12, 8)), np.zeros((1, 8))])


@pytest.mark.parametrize("k", [1, 10, 700])
def test_exact_search_equals_brute_force(spark, corpus, queries, k):
    df = frame(spark, corpus).repartition(6)
    assert hits(knn.nearest(df, frame(spark, queries, "query_id"), k)) == brute(corpus, queries, k)


def test_blocks_equal_brute_force(spark, corpus, queries):
    found = knn.nearest(frame(spark, corpus), frame(spark, queries, "query_id"), 10, block_values=5 * 8)
    assert hits(found) == brute(corpus, queries, 10)


def test_text_ids_break_ties_in_order(spark):
    ids = [f"é{i:03d}" if i % 2 else f"z{i:03d}" for i in range(50)]
    corpus = np.ones((50, 4))
    found = hits(knn.nearest(frame(spark, corpus, ids=ids).repartition(4), frame(spark, [[1, 1, 1, 1]], "query_id"), 5))
    assert [h[1] for h in found] == sorted(ids)[:5]


def test_no_queries_and_no_corpus(spark):
    some, none = frame(spark, np.ones((3, 4))), frame(spark, np.ones((1, 4))).limit(0)
    assert hits(knn.nearest(some, none.withColumnRenamed("id", "query_id"), 3)) == []
    assert hits(knn.nearest(none, frame(spark, np.ones((1, 4)), "query_id"), 3)) == []


def test_unequal_lengths_fail(spark):
    with pytest.raises(Exception, match="VectorLengthError"):
        knn.nearest(frame(spark, np.ones((3, 4))), frame(spark, np.ones((1, 5)), "query_id"), 1).collect()


@pytest.mark.parametrize("block_values", [knn.BLOCK_VALUES, 16])
def test_index_with_all_cells_is_exact(spark, corpus, queries, block_values):
    index = ivf.build(frame(spark, corpus), 6)
    asked = frame(spark, queries, "query_id")
    probing = asked.withColumn("probe", F.array(*[F.lit(c) for c in range(6)]))
    found = knn.nearest(index.rows, probing, 10, cells=6, block_values=block_values)
    assert hits(found) == hits(index.search(asked, 10, probes=6)) == brute(corpus, queries, 10)


def test_closest_cells_in_slices(monkeypatch):
    rows, cells = ivf._unit(RNG.normal(size=(300, 5))), ivf._unit(np.repeat(RNG.normal(size=(20, 5)), 2, axis=0))
    want = np.argsort(-np.round(rows @ cells.T, 9), axis=1, kind="stable")
    monkeypatch.setattr(ivf, "SLICE_VALUES", 7 * len(cells))
    for n in (1, 3, 40):
        assert (ivf._closest(rows, cells, n) == want[:, :n]).all()


def test_vectors_without_a_distance_fail(spark):
    with pytest.raises(Exception, match="VectorValueError"):
        knn.nearest(frame(spark, [[1.0, float("nan")]]), frame(spark, [[1.0, 0.0]], "query_id"), 1).collect()


def test_index_survives_a_round_trip_and_opens_probed_cells_only(spark, corpus, queries, folder):
    index = ivf.build(frame(spark, corpus), 6)
    index.write(folder)
    loaded = ivf.load(spark, folder)
    assert loaded.sizes().agg(F.sum("rows")).first()[0] == len(corpus)
    asked = frame(spark, queries[:1], "query_id")
    few, all_ = loaded.search(asked, 10, probes=2), loaded.search(asked, 10, probes=6)
    assert hits(all_) == brute(corpus, queries[:1], 10)
    assert "PartitionFilters: [cell" in few._jdf.queryExecution().toString()
    every = frame(spark, queries, "query_id")
    assert stats.recall(loaded.search_all(every, 10), knn.nearest(loaded.rows, every, 10), 10).first()["recall"] == 1.0
    exact = ivf.ExactIndex(loaded.rows).search(asked, 3)
    assert hits(exact) == brute(corpus, queries[:1], 3)


def test_self_nearest(spark):
    vectors = RNG.normal(size=(2500, 4))
    df = frame(spark, vectors)
    sample = df.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    assert tuple(knn.self_nearest(df, sample).first()) == (25, 25)


def test_orphans_never_surface(spark):
    docs = spark.createDataFrame([("a", "ta", "{}"), ("b", "tb", None), ("d", "td", "{}")], "id string, text string, meta string")
    vectors = frame(spark, [[1, 0], [0.9, 0.1], [1, 0.01]], ids=["a", "b", "x"])
    found = knn.search_documents(vectors, docs, frame(spark, [[1, 0]], "query_id"), 3)
    assert [(r.rank, r.id, r.text) for r in found.orderBy("rank").collect()] == [(1, "a", "ta"), (2, "b", "tb")]
    assert tuple(knn.integrity(vectors, docs).first()) == (1, 1, False)
    assert tuple(knn.integrity(vectors.filter("id <> 'x'"), docs.filter("id <> 'd'")).first()) == (0, 0, True)


def test_hash_model_agrees_with_buckets(spark):
    texts = ["Acme has CDC-2 café X x", "", None, "zebra " * 50 + "İ apple", "ABC abc aBc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    dense = {r.id: r.emb for r in docs.select("id", embedding.hash_vector(F.col("text"), 16).alias("emb")).collect()}
    counts = {i: np.zeros(16) for i in range(len(texts))}
    for r in embedding.hash_buckets(docs, 16).collect():
        counts[r.id][r.bucket] = r.n
    for i, n in counts.items():
        norm = np.linalg.norm(n)
        assert dense[i] == pytest.approx(list(n / norm if norm else n), abs=1e-6)
    assert sum(dense[1]) == 0 and sum(dense[2]) == 0


def test_each_text_is_embedded_once(spark):
    docs = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", None)], "id string, text string")
    stored = embedding.embed_documents(docs, embedding.hash_model(8), "m1")
    changed = spark.createDataFrame([("a", "one"), ("b", "TWO"), ("c", ""), ("d", "new")], "id string, text string")
    again = embedding.needs_embedding(changed, stored, "m1")
    assert tuples(again) == [("b", "TWO"), ("d", "new")]
    assert embedding.needs_embedding(changed, stored, "m2").count() == 4
    assert embedding.of_model(stored, "m1").count() == 3
    with pytest.raises(Exception, match="query model m2, stored model m1"):
        embedding.of_model(stored, "m2").collect()


def test_prompts(spark):
    found = spark.createDataFrame([(1, 2, "second"), (1, 1, "first")], "query_id int, rank int, text string")
    asked = spark.createDataFrame([(1, "why?"), (2, "who?")], "query_id int, query string")
    got = dict(tuples(prompts.cited_prompts(found, asked)))
    assert got[1] == (
        "Answer the question using ONLY the numbered sources, citing inline like [1]. If they don't answer it, "
        "say so.\n\nSources:\n[1] first\n[2] second\n\nQuestion: why?\nAnswer:"
    )
    assert "Sources:\n\nQuestion: who?" in got[2]


def test_generation(spark):
    df = spark.createDataFrame([("p1",), ("p2",)], "prompt string")
    shout = lambda prompts_: [f" {p.upper()} " for p in prompts_]
    assert tuples(df.select(embedding.generate_column(F.col("prompt"), shout))) == [("P1",), ("P2",)]
    assert tuples(df.select(embedding.generate_column(F.col("prompt"), None))) == [("",), ("",)]
    assert "offline" in df.select(embedding.generate_column(F.col("prompt"), embedding.offline_answers)).first()[0]


def test_more_cells_than_allowed_are_refused(spark, corpus, monkeypatch):
    monkeypatch.setattr(ivf, "MAX_CELLS", 3)
    with pytest.raises(ValueError, match="cells must be"):
        ivf.around(frame(spark, corpus), np.eye(4, len(corpus[0])))


def test_cells_are_opened_until_nothing_is_missed(spark, folder):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(12, 6)) * 4
    corpus = np.concatenate([middles[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 6)) * 0.2, np.zeros((2, 6)), middles[:3], middles[:3]])
    asked = np.concatenate([corpus[:40], rng.normal(size=(20, 6)), np.zeros((1, 6))])
    index = ivf.stored(ivf.build(frame(spark, corpus), 12), folder)
    for k in (1, 10, 400):
        found, opened = index.opened(frame(spark, asked, "query_id"), k)
        assert hits(found) == brute(corpus, asked, k)
    sizes = {r["cell"]: r["rows"] for r in index.sizes().collect()}
    found, opened = index.opened(frame(spark, asked[:40], "query_id"), 10)
    searched = sum(sizes[c] for r in opened.collect() for c in r["cells"]) / (40 * len(corpus))
    assert searched < 0.4
    fresh = ivf.around(frame(spark, corpus), index.centroids)
    assert hits(fresh.search_all(frame(spark, asked, "query_id"), 10, first=3)) == brute(corpus, asked, 10)


def test_registered_search_has_its_recall(spark):
    from tributary.plans import retrieval

    found = retrieval.recall_at_k(spark, "/root/testdata/sf0.001").first()
    assert found["queries"] > 0 and found["recall"] >= 0.9


def test_what_a_task_gathers_does_not_grow_with_its_rows(monkeypatch):
    import pyarrow as pa

    rows, asked = RNG.normal(size=(4000, 8)), RNG.normal(size=(200, 8))
    rows[1000:1200] = rows[0]  # ties go to the smaller id, also from a later batch
    gathered = []
    whole = knn._best

    def watched(found, k):
        gathered.append(found.num_rows)
        return whole(found, k)

    monkeypatch.setattr(knn, "CELL_VALUES", 4000)
    monkeypatch.setattr(knn, "FOUND_ROWS", 5000, raising=False)
    monkeypatch.setattr(knn, "_best", watched)
    vec = pa.FixedSizeListArray.from_arrays(pa.array(rows.astype("f4").ravel()), 8).cast(pa.list_(pa.float32()))
    order = np.arange(4000)[::-1].copy()
    batch = pa.RecordBatch.from_arrays([pa.array(order), vec.take(pa.array(order))], ["id", "vec"])
    unit = knn._matrix(pa.array(asked.astype("f4").tolist(), pa.list_(pa.float32())), 8)
    for k in (1, 10, 5000):
        gathered.clear()
        told = pa.Table.from_batches(knn._scorer(pa.array(range(200)), unit, None, k)(iter([batch]))).to_pydict()
        want = [(q, i, d) for q, i, d, _ in brute(rows, asked, k)]
        assert sorted(zip(told["query_id"], told["dist"], told["id"])) == sorted((q, d, i) for q, i, d in want)
        if k <= 10:
            assert max(gathered) <= 5000 + 4000 + 200 * k
