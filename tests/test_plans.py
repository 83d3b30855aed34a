"""Plan-shape regressions: the scale properties of the physical plans."""

from __future__ import annotations

import pytest

from churnlens.operators import scoring, segments
from churnlens.plans.catalog import QUERIES
from churnlens.plans.context import Workspace
from churnlens.sources import fixture
from helpers import SF_SMALL, make_requests, make_subs

SINKS = {"csv_roundtrip", "store_roundtrip", "warehouse_append", "churned_customers", "score_stream"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SINKS))
def test_no_cartesian_no_python(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, (name, bad)


def test_orders_aggregated_before_shuffle(spark):
    ws = Workspace(spark, SF_SMALL)  # fresh, lazy derivation
    plan = _plan(fixture.subscriber_base(ws.tables.customer, ws.tables.orders))
    # partial aggregate (map-side combine) below the exchange on the customer key
    assert "partial_count" in plan and "partial_max" in plan and "partial_min" in plan
    assert plan.index("partial_count") > plan.index("Exchange hashpartitioning(o_custkey")


def test_events_aggregated_before_shuffle(spark):
    ws = Workspace(spark, SF_SMALL)
    plan = _plan(fixture.usage_summary(ws.tables.events))
    assert "partial_sum" in plan and "Exchange hashpartitioning(user_id" in plan


def test_row_level_operators_do_not_shuffle(spark):
    subs, requests = make_subs(spark, [{}]), make_requests(spark, [{}])
    scored = scoring.score(scoring.valid_requests(requests))
    for df in (segments.segment_members(subs), scored, scoring.factor_rows(scored),
               scoring.recommendation_rows(scored), scoring.rejected_requests(requests)):
        assert "Exchange" not in _plan(df)


def test_queries_do_their_own_work(spark):
    # no query reads an answer that an earlier one stored
    for name in ("clean_median", "score_requests", "segments", "score_batch"):
        plan = _plan(QUERIES[name](spark, SF_SMALL))
        assert f"{SF_SMALL}/customer.parquet" in plan and f"{SF_SMALL}/orders.parquet" in plan, name


def test_filters_and_pruning_reach_the_scan(spark):
    plan = _plan(QUERIES["overview_filtered"](spark, SF_SMALL))
    assert "EqualTo(r_name,EUROPE)" in plan
    kpi_plan = _plan(QUERIES["kpis"](spark, SF_SMALL))
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in kpi_plan


def test_single_scan_for_multi_output_aggregates(spark):
    # six segment predicates and three distributions: one scan each of customer and orders
    # (and of the latest order date)
    for name in ("segments", "distributions"):
        plan = _plan(QUERIES[name](spark, SF_SMALL))
        assert plan.count("customer.parquet") == 1, name


def test_churned_scan_pushes_the_filter(spark):
    # S9: SELECT * FROM the warehouse table WHERE Churn = 1, filtered inside the Parquet scan
    before = {t.name for t in spark.catalog.listTables()}
    plan = _plan(QUERIES["churned_customers"](spark, SF_SMALL))
    assert "EqualTo(Churn,1)" in plan and "Exchange" not in plan
    assert {t.name for t in spark.catalog.listTables()} <= before
