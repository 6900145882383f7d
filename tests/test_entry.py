"""The driver's contract."""

from __future__ import annotations

import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, small):
    from thicket import plans

    plan = plans.QUERIES["triple_lookup"](spark, small)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)" in plan
    assert "l_shipdate" not in plan.split("Physical Plan")[1]


def test_no_cross_joins(spark, small):
    from thicket import plans

    for name in ("tree_sp", "leaf_pairs", "dedup_band", "perm_mask", "bin_assign_cont", "encode_left_join"):
        plan = plans.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
