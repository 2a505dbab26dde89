"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from checks import compare
from tributary.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return compare.database(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, database, name):
    assert compare.difference(spark, database, name, SF_DIR) is None


def test_entry_points(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_no_query_has_a_cross_join(spark):
    allowed = set()
    for name, query in catalogue.queries().items():
        if name == "stream_drain":
            continue
        plan = query(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            allowed.add(name)
    assert allowed == set()
