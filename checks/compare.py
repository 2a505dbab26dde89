"""Run every query and its SQL side by side and report differences.

Usage: python checks/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tributary.plans import catalogue  # noqa: E402
from tributary.plans.analytics import TABLES  # noqa: E402
from tributary.session import local_session  # noqa: E402


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """An in-process database with the test tables as views."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def difference(spark, con, name: str, sf_dir: str) -> str | None:
    """What differs between the query and its SQL, or None."""
    df = catalogue.queries()[name](spark, sf_dir)
    got = _rows(df.columns, df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    want = _rows(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if got != want:
        pairs = [(a, b) for a, b in zip(got, want) if a != b]
        return f"{len(pairs)} rows differ, first {str(pairs[0][0])[:300]} != {str(pairs[0][1])[:300]}"
    types_got = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    types_want = {c[0]: str(c[1]) for c in result.description}
    loose = {
        "bigint": {"BIGINT"}, "int": {"INTEGER"}, "string": {"VARCHAR", "JSON"}, "double": {"DOUBLE"},
        "boolean": {"BOOLEAN"}, "timestamp_ntz": {"TIMESTAMP"}, "timestamp": {"TIMESTAMP"},
    }
    odd = {c: (types_got[c], types_want[c]) for c in types_got if types_want[c] not in loose.get(types_got[c], set())}
    return f"types {odd}" if odd else None


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(catalogue.queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = database(sf_dir)
    bad = 0
    for name in names:
        started = time.monotonic()
        try:
            problem = difference(spark, con, name, sf_dir)
        except Exception as failure:  # report and go on with the next query
            problem = f"{type(failure).__name__}: {str(failure)[:600]}"
        checked = "sql" if name in catalogue.oracle_sql() else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:24} {checked:4} {time.monotonic() - started:6.2f}s {problem or ''}", flush=True)
        bad += problem is not None
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
