"""Line dedup against SQL and by hand."""

from checks import compare
from tests.llm import helpers as H
from tributary.llm import line_dedup, queries


def test_query_matches_sql(spark):
    con = compare.database(H.SF_DIR)
    found = queries.op4_line_dedup(spark, H.SF_DIR)
    result = con.execute(queries.SQL["op4_line_dedup"])
    names = [c[0] for c in result.description]
    assert H.plain(found.select(names).collect()) == H.plain(result.fetchall())


def _docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id bigint, text string, source string")


def test_spread_over_sites_counts_and_the_first_stays(spark):
    docs = _docs(
        spark,
        (1, "own 1\n menu \nown 1b", "a"), (2, "menu", "b"), (3, "x\r\nmenu\t\ny", "c"), (4, "menu\nmenu", "a"),
        (5, "often", "a"), (6, "often", "a"), (7, "often\nonce", "a"), (8, "\n\n", "b"),
    )
    found = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in line_dedup.without_boilerplate(docs, sites=3).collect()}
    assert found[1] == ("own 1\n menu \nown 1b", 0)
    assert found[2] == ("", 1) and found[3] == ("x\r\ny", 1) and found[4] == ("", 2)
    assert found[5] == ("often", 0) and found[7] == ("often\nonce", 0) and found[8] == ("\n\n", 0)


def test_lines_near_the_bound_are_counted_exactly(spark):
    rows = [(100 * n + i, f"line {n}", f"site {i}") for n in range(30, 51) for i in range(n)]
    known = line_dedup.boilerplate(line_dedup.lines(_docs(spark, *rows), "doc_id", "text", "source"), sites=40).count()
    assert known == sum(n >= 40 for n in range(30, 51))


def test_a_hot_line_and_columns_stay(spark):
    docs = _docs(spark, *[(i, f"hot line\nown words {i}", f"s{i % 9}") for i in range(3000)]).withColumnRenamed("source", "where")
    found = line_dedup.without_boilerplate(docs, site="where")
    assert found.columns == ["doc_id", "text", "where", "lines_in", "lines_removed"]
    assert sorted(r["doc_id"] for r in found.where("lines_removed = 0").collect()) == [0]
