import pytest
from pyspark.sql import functions as F

from tests.helpers import one
from tributary.functions import records, scalars, text, vectors


def test_tokens_split_on_everything_but_ascii_letters(spark):
    assert one(spark, "Acme has CDC-2 café X", text.tokens) == ["acme", "has", "cdc", "caf", "x"]
    assert one(spark, "İstanbul Straße", text.tokens) == ["stanbul", "stra", "e"]
    assert one(spark, "", text.tokens) == []
    assert one(spark, None, text.tokens) == []


FIELDS = [
    ('{"f":"x"}', "x", None),
    ('{"f":5}', None, 5),
    ('{"f":"5"}', "5", None),
    ('{"f":5.0}', None, None),
    ('{"f":4294967296}', None, None),
    ('{"f":null}', None, None),
    ('{"f":true}', None, None),
    ("{}", None, None),
    ("7", None, None),
    ("{oops", None, None),
    ('{"f":"x"} tail', None, None),
    ('{"f":"x"}}', None, None),
    ('{"f":"x"}] [', None, None),
    ('{"f":"x"},{"f":"y"}', None, None),
    ('{"f":"x"},"k":1', None, None),
    (' {"f":"x"} ', "x", None),
    ("", None, None),
    (None, None, None),
]


def test_fields_are_read_without_coercion(spark):
    df = spark.createDataFrame([(i, row[0]) for i, row in enumerate(FIELDS)], "i int, v string")
    doc = records.parsed(F.col("v"))
    got = df.select("i", records.text_at(doc, "$.f").alias("t"), records.int_at(doc, "$.f").alias("n"))
    assert {r.i: (r.t, r.n) for r in got.collect()} == {i: row[1:] for i, row in enumerate(FIELDS)}


def test_lists_keep_non_empty_strings_only(spark):
    read = lambda v: records.texts_at(records.parsed(v), "$.c")
    assert one(spark, '{"c":["H01","H01","",5,"A61",null,["x"]]}', read) == ["H01", "H01", "A61"]
    assert one(spark, '{"c":"H01"}', read) == []
    assert one(spark, "{}", read) == []


def test_json_or_string(spark):
    assert one(spark, '{"a":1}', records.json_or_string) == '{"a":1}'
    assert one(spark, 'say "hi"', records.json_or_string) == '"say \\"hi\\""'
    assert one(spark, None, records.json_or_string) == '""'


def test_scalar_rules(spark):
    assert [one(spark, c, scalars.op_name, "int") for c in (1, 0, -1, 2, None)] == ["insert", "update", "delete", None, None]
    assert [one(spark, d, scalars.year_of) for d in ("2020-01-05", "20x0", "", None, "19995")] == [2020, None, None, None, 1999]
    assert [one(spark, t, scalars.byte_length) for t in ("é", None, "")] == [2, 0, 0]
    assert one(spark, "data: {}  \r", scalars.payload_of_line) == "{}"
    assert one(spark, "event: x", scalars.payload_of_line) is None
    assert one(spark, "data: ", scalars.payload_of_line) is None  # its end is stripped with the prefix's blank


def test_line_class_takes_the_first_match(spark):
    expected = {
        "push failed: x (pushed)": "err", "thread panic at": "err", "stored=3 (pushed)": "ok",
        "[retrieval] 3ms": "ok", "reconnect in 3s": "warn", "hello": "",
    }
    df = spark.createDataFrame([(line,) for line in expected], "v string")
    assert {r.v: r.c for r in df.select("v", scalars.line_class(F.col("v")).alias("c")).collect()} == expected


def test_overhead_and_ratio(spark):
    row = spark.range(1).select(
        scalars.overhead_pct(F.lit(200.0), F.lit(150.0)).alias("lost"),
        scalars.overhead_pct(F.lit(0.0), F.lit(150.0)).alias("no_base"),
        scalars.amplification(F.lit(0.0), F.lit(9.0)).alias("grown"),
        scalars.ratio(F.lit(9.0), F.lit(0.0)).alias("by_zero"),
    ).first()
    assert tuple(row) == (25.0, 0.0, 9.0, 0.0)


@pytest.mark.parametrize(
    "a, b, distance",
    [([1, 2], [1, 2], 0.0), ([1, 0], [0, 3], 1.0), ([1, 1], [-1, -1], 2.0), ([0, 0], [1, 2], 1.0), ([0, 0], [0, 0], 1.0)],
)
def test_cosine_distance(spark, a, b, distance):
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<float>, b array<float>")
    got = df.select(vectors.cosine_distance(F.col("a"), F.col("b")).alias("d")).first()["d"]
    assert got == pytest.approx(distance, abs=1e-9)


def test_cosine_distance_refuses_unequal_lengths(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="vector lengths differ: 1 and 2"):
        df.select(vectors.cosine_distance(F.col("a"), F.col("b"))).collect()


def test_vector_text(spark):
    write = lambda v: vectors.vector_to_json(v)
    assert one(spark, [], write, "array<float>") == "[]"
    assert one(spark, [1.0, -0.5], write, "array<float>") == "[1.000000,-0.500000]"
    assert one(spark, "[1.0,-0.5]", vectors.vector_from_json) == [1.0, -0.5]
    assert one(spark, [3.0, 4.0], vectors.l2_normalise, "array<float>") == pytest.approx([0.6, 0.8])
    assert one(spark, [0.0, 0.0], vectors.l2_normalise, "array<float>") == [0.0, 0.0]


def test_vector_text_is_rounded_as_c_prints_it(spark):
    import struct

    write = lambda v: vectors.vector_to_json(v)
    halves = [k / 128 for k in range(-129, 130)]  # every odd one is half way between two numbers of six places
    others = [0.0, -0.0, -1e-9, 5e-7, 1.5e-6, 0.1, 1 / 3, 8388607.5, 8388608.0, 1e9, -16777216.0]
    values = [struct.unpack("f", struct.pack("f", x))[0] for x in halves + others]
    assert one(spark, values, write, "array<float>") == "[" + ",".join("%.6f" % x for x in values) + "]"
    assert one(spark, [3.0 / 64], lambda v: vectors.vector_to_json(v, 5), "array<float>") == "[0.04688]"
    assert one(spark, [1.0 / 64], lambda v: vectors.vector_to_json(v, 5), "array<float>") == "[0.01562]"
