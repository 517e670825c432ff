from __future__ import annotations

import pytest
from oracle_check import compare, connect

from gleaner.plans.catalog import QUERIES
from gleaner.plans.oracle import ORACLE

SF = "0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, name, SF) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_query_without_sql_runs(spark, name):
    # After a query that observes its plan, as in a long session; a count alone would leave columns out.
    QUERIES["cascade_stage_counts"](spark, f"/root/testdata/sf{SF}").collect()
    assert QUERIES[name](spark, f"/root/testdata/sf{SF}").collect()


def test_sql_belongs_to_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_pairwise_join_in_any_plan(spark, name):
    plan = QUERIES[name](spark, f"/root/testdata/sf{SF}")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
