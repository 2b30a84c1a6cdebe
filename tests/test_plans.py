"""Registered queries: contract, and physical plans that hold at scale."""

import re

import pytest

import __spark_entry__ as entry
from climrisk.plans import registry
from tests.conftest import SF

# Training runs jobs while the plan is built; the others only describe work.
TRAINED = {
    "model_lr", "model_rf", "model_gbt", "model_tune", "importance", "explain_linear",
    "risk_forecasts", "forecast_legend", "forecast_registry",
}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == [
        "series",
        "date",
        "value",
        "total",
        "p95_accumulated",
        "p99_accumulated",
        "level",
    ]
    assert df.where("level IS NOT NULL").count() > 100


@pytest.mark.parametrize("name", sorted(set(registry.PLANS) - TRAINED))
def test_plan_shape(spark, name):
    plan = plan_of(registry.PLANS[name](spark, SF))
    assert "CartesianProduct" not in plan, "no cross joins"
    assert "BroadcastNestedLoopJoin" not in plan, "no nested loops"
    whole_table = re.findall(r"Exchange SinglePartition.*\n(.*)", plan)
    for below in whole_table:
        small = ("HashAggregate", "SortAggregate", "Limit", "Project", "WholeStage", "Sort")
        assert any(s in below for s in small), f"a whole table in one task: {below}"


def test_windows_without_partition_only_see_one_row_per_year(spark):
    for name in sorted(set(registry.PLANS) - TRAINED):
        plan = plan_of(registry.PLANS[name](spark, SF))
        for line in plan.splitlines():
            if "Window [" in line and re.search(r"\], \[_y#", line) is None:
                spec = re.search(r"windowspecdefinition\(([^#]+)#", line)
                assert spec is not None, (name, line)


def test_columns_and_filters_reach_the_scan(spark):
    plan = plan_of(registry.PLANS["rolling_sum_strict"](spark, SF))
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    for columns in scans:
        assert set(re.findall(r"(\w+):", columns)) <= {"l_suppkey", "l_quantity", "l_shipdate"}
    plan = plan_of(registry.PLANS["risk_lookup"](spark, SF))
    assert "event_type" in plan and "PushedFilters: [IsNotNull" in plan


def test_point_location_shuffles_no_point_twice(spark):
    """Points meet the index in one equi join and are never regrouped."""
    plan = plan_of(registry.PLANS["point_in_polygon"](spark, SF))
    top = plan.splitlines()
    join = next(i for i, line in enumerate(top) if "Join" in line)
    assert not any("Aggregate" in line or "Exchange" in line for line in top[:join])
