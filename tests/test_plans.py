"""Properties of physical plans that keep the operators usable on large tables."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary import session
from tributary.operators import changes, grouping, knn, writeback
from tributary.plans import catalogue, inputs, retrieval
from tributary.sources import nodelogs

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df):
    """Operator names, outermost first."""
    return re.findall(r"^[\s:+\-|]*(?:\*\(\d+\) )?(\w+)", plan(df), re.M)


def test_reports_read_the_columns_they_use(spark):
    text = plan(catalogue.queries()["q1_top_groups"](spark, SF_DIR))
    assert "TakeOrderedAndProject" in text and "ReadSchema: struct<l_suppkey:bigint>" in text
    assert "PushedFilters: [IsNotNull(l_suppkey)]" in text


def test_joined_counts_count_before_they_join(spark):
    facts = spark.range(10).withColumn("k", F.col("id") % 3)
    dim = spark.range(3).withColumn("g", F.lit("x"))
    names = operators(grouping.joined_counts(facts, "k", dim, "id", "g").hint("none"))
    join = next(i for i, n in enumerate(names) if n.endswith("Join"))
    assert names[join + 1 :].count("HashAggregate") >= 2


def test_the_fold_combines_before_its_only_shuffle(spark):
    log = spark.range(10).select(F.col("id").alias("change_id"), (F.col("id") % 3).alias("id"), F.lit("x").alias("image"))
    text = plan(changes.fold(log))
    assert text.count("Exchange") == 1 and text.index("Exchange") < text.index("partial_max_by")


def test_limits_per_group_cut_before_the_shuffle(spark):
    key = F.concat(F.lit("n"), F.col("id") % 3)
    lines = spark.range(10).select(key.alias("node"), F.col("id").alias("position"), F.lit("l").alias("line"))
    box = spark.range(10).select(key.alias("src"), F.col("id").alias("seq"), F.lit("p").alias("payload"))
    for df in (nodelogs.tail(lines, 3), writeback.next_page(box, 3)):
        assert [n for n in operators(df) if n in ("WindowGroupLimit", "Exchange")] == ["WindowGroupLimit", "Exchange", "WindowGroupLimit"]


def test_search_moves_candidates_and_not_the_corpus(spark, folder):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.eye(6))]
    spark.createDataFrame(rows, "id bigint, emb array<float>").write.parquet(f"{folder}/v")
    corpus = spark.read.parquet(f"{folder}/v")
    names = operators(knn.nearest(corpus, corpus.limit(2).withColumnRenamed("id", "query_id"), 3))
    assert "Exchange" not in names[names.index("MapInArrow") :]
    assert names.count("WindowGroupLimit") == 4 and names.count("Exchange") == 2


def test_documents_are_embedded_without_python_and_after_the_cut(spark):
    vectors = retrieval._labelled_vectors(spark, SF_DIR)
    names = operators(vectors)
    assert not any("Python" in n or "Arrow" in n for n in names)
    assert "md5" in plan(vectors).split("LeftSemi")[0] and "md5" not in plan(vectors).split("LeftSemi")[1]


def test_filters_do_not_parse_again(spark):
    decoded = changes.decode(inputs.event_log(spark, SF_DIR)).filter(F.col("op") == "insert")
    assert plan(decoded).count("parseJson") <= 4  # two images, parsed a second time only where a text holds "]"


class Settings:
    """A stand-in for a session: a master, and settings that may name the shared folder."""

    def __init__(self, master, named=None):
        self.master, self.named, self.sparkContext, self.conf = master, named, self, self

    def get(self, key, default=None):
        return self.named if key == "spark.checkpoint.dir" else default

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return None

    def setCheckpointDir(self, folder):
        self.named = folder


def test_shared_folder_comes_from_the_session(spark):
    assert session.shared_dir(Settings("spark://host:7077", "hdfs://shared")) == "hdfs://shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Settings("spark://host:7077"))
    alone = Settings("local[2]")
    assert session.shared_dir(alone) == alone.named
    kept = session.written_once(spark.range(5))
    assert kept.count() == 5 and "/written/" in plan(kept)
