"""Physical-plan properties that matter at scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL


def _final_plan(df) -> str:
    df._jdf.queryExecution().toRdd().count()  # runs this very plan: AQE makes it final
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    return plan


def test_flagship_join_reuses_the_aggregate_partitioning(spark):
    plan = entry.queries()["a9_pnl_daily"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "FullOuter" in plan


def test_period_bounds_and_columns_reach_the_scan(spark):
    df = entry.queries()["a9_pnl_daily"](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    assert "ReadSchema: struct<l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>" in plan


@pytest.mark.parametrize("key", ["w6_cascade", "a14_top_vehicles_by_month", "a15_eligibles_by_month",
                                 "l2_random_pick", "m10_autodraw", "q5_receipt_numbers", "m7_approve"])
def test_order_dependent_jobs_never_gather_into_one_partition(spark, key):
    plan = _final_plan(entry.queries()[key](spark, SMALL))
    assert "SinglePartition" not in plan
    for line in plan.split("\n"):
        if "Window [" in line:
            assert not line.rstrip().endswith("[]"), line      # every window is partitioned
