"""Schemas of the tables and records the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
    "array<float>": T.ArrayType(T.FloatType()),
}


def struct(columns: str) -> T.StructType:
    """A schema from ``"name type, name type not null, ..."``; needs no running session."""
    fields = []
    for column in columns.split(","):
        name, kind, *rest = column.split()
        fields.append(T.StructField(name, _TYPES[kind], rest != ["not", "null"]))
    return T.StructType(fields)


PATENTS = struct(
    "patent_id string not null, title string, abstract string, assignee string, "
    "grant_date string, grant_year int, claims_len int, n_cpc int, n_citations int"
)
PATENT_CPC = struct("patent_id string not null, cpc string not null, cpc_section string not null")
PATENT_CITATIONS = struct("patent_id string not null, cited_id string not null")

OUTBOX = struct("src string, seq bigint, ts bigint, payload string")
ACKS = struct("src string, seq bigint")

# One row per captured change. Images are JSON objects in text; change_type is 1, 0 or -1.
CHANGE_LOG = struct(
    "change_id bigint, change_type int, table_name string, before string, after string"
)
RUN_RESULT = struct("run_id string, name string, metric string, value double, run_ts timestamp")

# What a comparison run of any capture approach reports.
CAPTURE_METRICS = struct(
    "stack string, rows bigint, ingest_seconds double, rows_per_sec double, "
    "cdc_events_captured bigint, capture_lag_ms_p50 double, storage_bytes bigint, notes string"
)


class SchemaMismatch(ValueError):
    """A DataFrame does not have the columns or types a table asks for."""


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` to ``schema`` in column order; raise if a column is absent or differs in type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for field in schema.fields:
        if field.name not in have:
            raise SchemaMismatch(f"column {field.name!r} is missing; found {sorted(have)}")
        if have[field.name].simpleString() != field.dataType.simpleString():
            raise SchemaMismatch(
                f"column {field.name!r} is {have[field.name].simpleString()}, "
                f"expected {field.dataType.simpleString()}"
            )
    return df.select(*[field.name for field in schema.fields])
