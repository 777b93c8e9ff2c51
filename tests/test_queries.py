"""Every registered query against DuckDB on the smallest tables, and plan checks."""

from __future__ import annotations

from pathlib import Path

import pytest
from compare import connect, differences

from emberline.plans.registry import catalogue

SF = "/root/testdata/sf0.001"
QUERIES = catalogue()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_matches_sql(spark, con, name):
    query, sql = QUERIES[name]
    assert differences(query(spark, SF), con, sql) == []


@pytest.mark.parametrize("name", ["b11_valid_rows", "d4_dominant_event_type", "d6_distinct_actors", "e1_representatives", "h4_chunks"])
def test_no_python_in_plan(spark, name):
    plan = QUERIES[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(p in plan for p in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "CartesianProduct"))


def test_group_limit_before_shuffle(spark):
    plan = QUERIES["e1_representatives"][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
