import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import lines, tuples
from tributary import schemas
from tributary.sources import changelog, feeds, nodelogs, patents, star


def raw(**fields):
    return json.dumps(fields)


def test_records_without_key_and_blank_lines_are_skipped(spark):
    df = patents.parse_lines(lines(spark, "", "  ", "\t", raw(title="x"), raw(patent_id="p"), "5"))
    assert [r.patent_id for r in df.collect()] == ["p"]


def test_limit_counts_kept_records_only(spark):
    df = lines(spark, raw(title="x"), raw(patent_id="a"), "", raw(patent_id="b"), raw(patent_id="c")).coalesce(1)
    assert [r.patent_id for r in patents.parse_lines(df, limit=2).collect()] == ["a", "b"]


def test_a_malformed_line_fails_the_job_or_is_quarantined(spark):
    df = lines(spark, raw(patent_id="a"), "{oops")
    with pytest.raises(Exception, match="line is not JSON"):
        patents.parse_lines(df).collect()
    assert [r.patent_id for r in patents.parse_lines(df, permissive=True).collect()] == ["a"]
    assert [r.value for r in patents.rejected_lines(df).collect()] == ["{oops"]


def test_patent_star(spark):
    records = patents.parse_lines(
        lines(
            spark,
            raw(patent_id="a", title=5, claims="é", grant_date="2020-01-05", cpc_codes=["H01", "H01", "", 5, "A61"], cited_patent_ids=["p1", "p1"]),
            raw(patent_id="b", grant_date="20x0", assignee="ACME"),
            raw(patent_id="c", grant_date="", abstract="t"),
        )
    )
    fact = patents.patents(records)
    schemas.conform(fact, schemas.PATENTS)
    assert tuples(fact) == [
        ("a", None, None, None, "2020-01-05", 2020, 2, 2, 2),
        ("b", None, None, "ACME", "20x0", None, 0, 0, 0),
        ("c", None, "t", None, None, None, 0, 0, 0),
    ]
    assert [tuple(r) for r in patents.patent_cpc(records).collect()] == [("a", "A61", "A"), ("a", "H01", "H")]
    assert tuples(patents.patent_citations(records)) == [("a", "p1"), ("a", "p1")]
    assert tuples(patents.id_and_abstract(fact)) == [("a", ""), ("b", ""), ("c", "t")]


def edit(**fields):
    event = {"type": "edit", "wiki": "enwiki", "namespace": 0, "title": "T", "comment": "c", "meta": {"id": "e1", "uri": "u"}}
    return "data: " + json.dumps(event | fields)


def test_edit_feed_filters(spark):
    kept = feeds.edit_documents(
        lines(
            spark, edit(type="log"), edit(wiki="dewiki"), edit(namespace=1), edit(namespace="0"), edit(title=""),
            "data: {oops", "event: message", ": keepalive", edit(type="new") + "  ",
        ),
        wiki="enwiki",
        namespace="0",
    ).collect()
    assert [(r.id, r.text, json.loads(r.meta)) for r in kept] == [
        ("e1", "T: c", {"title": "T", "url": "u", "source": "wikimedia"})
    ]


def test_edit_feed_without_filters_and_ids(spark):
    found = feeds.edit_documents(lines(spark, edit(meta={}, comment=None), edit(wiki="x", namespace=7, meta="y")), "", "")
    assert [(r.id, r.text, json.loads(r.meta)["url"]) for r in found.collect()] == [(":T", "T: ", ""), (":T", "T: c", "")]
    named = feeds.edit_documents(lines(spark, edit(meta={})), wiki="enwiki")
    assert named.first()["id"] == "enwiki:T"


def test_malformed_events_can_be_kept_apart(spark):
    df = lines(spark, edit(), "data: {oops", "event: message", "data: 5")
    assert [r.value for r in feeds.rejected_lines(df).collect()] == ["data: {oops"]


def test_stories(spark):
    items = lines(
        spark, raw(id=1, title="A", text="b", url="u"), raw(id=2, title="C"), raw(id=3, title=""), raw(id=4), "null"
    )
    found = {r.id: (r.text, json.loads(r.meta)["url"]) for r in feeds.story_documents(items).collect()}
    assert found == {"hn:1": ("A. b", "u"), "hn:2": ("C. ", "https://news.ycombinator.com/item?id=2")}
    assert feeds.story_documents(items, max_items=1).count() == 1


def test_sources_by_name(spark, folder):
    assert feeds.source("none") is None and feeds.source("anything") is None
    assert feeds.source("demo")(spark).count() == 6
    lines(spark, edit()).write.text(f"{folder}/landed")
    assert feeds.source("wikimedia")(spark, f"{folder}/landed", wiki="enwiki").count() == 1


def test_tables(spark, folder):
    with pytest.raises(star.MissingTable, match="no table at"):
        star.first_rows(spark, f"{folder}/absent.parquet")
    numbers = spark.range(30).withColumn("patent_id", F.concat(F.lit("P"), "id"))
    for name, schema in star.STAR.items():
        rows = numbers.select(*[F.col("id").cast(f.dataType).alias(f.name) if f.name != "patent_id" else "patent_id" for f in schema])
        star.write_table(rows, f"{folder}/{name}.parquet", schema, rows_per_file=10)
    star.register_star(spark, folder)
    assert spark.sql("SELECT count(*) FROM patents").first()[0] == 30
    assert star.first_rows(spark, f"{folder}/patents.parquet", 7).count() == 7
    with pytest.raises(schemas.SchemaMismatch, match="cpc_section"):
        star.write_table(numbers.select(F.lit("a").alias("patent_id"), F.lit("b").alias("cpc")), f"{folder}/x", schemas.PATENT_CPC)
    with pytest.raises(schemas.SchemaMismatch, match="expected string"):
        schemas.conform(spark.createDataFrame([(1, "x")], "patent_id bigint, cited_id string"), schemas.PATENT_CITATIONS)


def test_change_log_scan(spark, folder):
    rows = [(i, 1, "docs" if i % 2 else "other", None, "{}") for i in range(10)]
    spark.createDataFrame(rows, schemas.CHANGE_LOG).write.parquet(f"{folder}/log")
    read = changelog.read_changes(spark, f"{folder}/log", "docs", 4)
    assert sorted(r.change_id for r in read.collect()) == [5, 7, 9]
    plan = read._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(table_name), IsNotNull(change_id), EqualTo(table_name,docs), GreaterThan(change_id,4)]" in plan


def test_log_tail_from_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(500)))
    (tmp_path / "b.log").write_text("only " + "x" * 1000 + "\n")
    (tmp_path / "c.txt").write_text("not a log\n")
    got = nodelogs.tail(nodelogs.read_logs(spark, str(tmp_path)), 3, width=600).orderBy("node", "back").collect()
    assert [(r.node, r.line[:8]) for r in got] == [("a", "line 499"), ("a", "line 498"), ("a", "line 497"), ("b", "only xxx")]
    assert len(got[-1].line) == 600
