"""Every registered query against its SQL counterpart at the smallest scale."""

import pytest

import __spark_entry__ as contract
from checks.compare_engines import difference, duckdb_over
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duckdb_over(SF)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_and_plan_is_distributed(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "MapInPandas"):
        assert operator not in plan
    assert difference(df, con, name) is None


def test_entry_is_a_full_day(spark):
    rows = contract.entry(spark).collect()
    assert sorted(r["trip_start_hour"] for r in rows) == list(range(24))
    assert sum(r["percentage_of_trips"] for r in rows) == pytest.approx(100, abs=1e-4)
