"""The subscriber cube against the operators, the median, huge numbers and the binned density."""

from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.operators import breakdowns, clean, cube, density, kpi, overview, segments
from churnlens.plans import report
from churnlens.plans.catalog import QUERIES
from churnlens.plans.context import Workspace
from helpers import SF_SMALL, make_subs

PAIRS = [(cube.kpis, kpi.kpis), (cube.churn_by_tenure, breakdowns.churn_by_tenure), (cube.revenue_by_band, breakdowns.revenue_by_band),
         (cube.retention_by_offer, breakdowns.retention_by_offer), (cube.overview_summary, overview.overview_summary),
         (cube.value_distributions, overview.value_distributions)]


def _random_subs(spark, n):
    rng = random.Random(3)
    rows = [dict(tenure=rng.choice([None, 0, 5, 6, 13, 40, 72, 80]), MonthlyCharges=rng.choice([None, 10.005, 45.0, 95.5, 130.0]),
                 TotalCharges=rng.choice([None, 0.0, 100.015, 2500.5]), Churn=rng.choice([None, 0, 1]),
                 Contract=rng.choice([None, "Month-to-month", "One year", "Two year"]),
                 InternetService=rng.choice([None, "No", "DSL", "Fiber optic"]), PhoneService=rng.choice(["Yes", "No"]))
            for _ in range(n)]
    return make_subs(spark, rows)


@pytest.mark.parametrize("n", [0, 1, 400])
def test_projections_equal_the_operators(spark, n):
    subs = _random_subs(spark, n)
    cells = cube.subscriber_cube(subs)
    for projected, plain in PAIRS:
        want = plain(subs)
        got = projected(cells).select(*want.columns)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str), plain.__name__


def test_cubes_of_parts_add_up(spark):
    subs = _random_subs(spark, 300).withColumn("part", F.abs(F.hash("customerID")) % 3)
    parts = [cube.subscriber_cube(subs.where(F.col("part") == k)) for k in range(3)]
    whole = cube.subscriber_cube(subs)
    assert sorted(cube.merged(*parts).select(*whole.columns).collect(), key=str) == sorted(whole.collect(), key=str)


def test_overlaps(spark):
    subs = _random_subs(spark, 300)
    members = {s.ordinal: {r.customerID for r in subs.where(s.condition()).collect()} for s in segments.SEGMENTS}
    got = {(r["first"], r["second"]): (r.customers, r.share) for r in cube.segment_overlaps(subs).collect()}
    assert len(got) == 15
    for (a, b), (n, share) in got.items():
        both, either = members[a] & members[b], members[a] | members[b]
        assert n == len(both) and (share is None if not either else abs(share - 100 * len(both) / len(either)) <= 0.05)
    assert {r.share for r in cube.segment_overlaps(subs.limit(0)).collect()} == {None}


def test_report_reads_subscribers_once(spark):
    ws = Workspace(spark, SF_SMALL)
    plan = report.report_sections(ws.subs, None, ["kpis", "churn", "segments"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("customer.parquet") == 1
    empty = report.report_sections(make_subs(spark, []), None, ["kpis", "churn", "segments"], report_date="1998-12-31")
    rows = {(r.section, r.label): r.value for r in empty.collect()}
    assert rows["kpis", "total_customers"] == 0 and rows["kpis", "arpu"] is None and rows["segments", "Low ARPU"] is None


def test_median(spark):
    rng = random.Random(7)
    for values in ([], [4.0], [1.0, 2.0], [3.0] * 50 + [9.0] * 50, [1e17, -1e17, 5.0], [rng.uniform(-5, 5) for _ in range(3001)],
                   [rng.expovariate(1) ** 9 for _ in range(500)] + [1e16], [1.0, 1e300, 2e300, float("inf")]):
        df = spark.createDataFrame([(v,) for v in values], "v double").union(
            spark.createDataFrame([(None,), (float("nan"),)], "v double"))
        got = clean.exact_median(df, "v").first().median
        assert got == (pytest.approx(statistics.median(values), rel=1e-12, abs=1e-9) if values else None)


def test_median_of_a_million_distinct_values(spark):
    df = spark.range(1_000_001).selectExpr("CASE WHEN id = 7 THEN 9e17D ELSE CAST(id * 7919 % 1000003 AS DOUBLE) / 8 END AS v")
    values = [9e17 if i == 7 else (i * 7919 % 1000003) / 8 for i in range(1_000_001)]
    assert clean.exact_median(df, "v").first().median == statistics.median(values)


def test_median_plan_is_small(spark):
    # rows, sketch, counts: each reads the orders once
    plan = QUERIES["clean_median"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("orders.parquet") <= 3 * 2 and plan.count("customer.parquet") <= 3


def test_a_huge_cell_stops_nothing(spark):
    raw = Workspace(spark, SF_SMALL).raw
    raw = raw.withColumn("TotalCharges", F.when(F.col("customerID").endswith("7"), "1e20").otherwise(F.col("TotalCharges")))
    raw = raw.withColumn("MonthlyCharges", F.when(F.col("customerID").endswith("3"), 1e300).otherwise(F.col("MonthlyCharges")))
    subs = clean.clean_subscribers(raw)
    assert subs.where("TotalCharges >= 1e18 OR MonthlyCharges >= 1e18").count() == 0
    rough = make_subs(spark, [{"TotalCharges": 1e20, "MonthlyCharges": 1e19}, {"TotalCharges": 10.0, "MonthlyCharges": 20.0}])
    assert kpi.kpis(rough).first().clv == 10.0 and kpi.kpis(rough).first().arpu == 20.0
    for df in (subs, rough, clean.clean_subscribers(raw, fill="median")):
        for query in (kpi.kpis, breakdowns.revenue_by_band, overview.overview_summary, report.report_summary,
                      lambda d: density.histogram(d, "MonthlyCharges")):
            assert query(df).count() >= 0 and query(df).collect()


def test_binned_density_is_within_its_error(spark):
    n = 200_000
    df = spark.range(n).selectExpr("CASE WHEN id % 3 = 0 THEN sqrt(id) ELSE exp(pmod(id * 7919, 100003) / 2e4) * 30 END AS x")
    x = np.array([r.x for r in df.collect()])
    h = x.std(ddof=1) * n ** -0.2
    points = np.linspace(x.min(), x.max(), 50)
    exact = np.array([np.exp(-0.5 * ((p - x) / h) ** 2).sum() for p in points]) / (n * h * np.sqrt(2 * np.pi))
    for error in (1e-2, 1e-6):
        got = density.kde_binned(df, "x", grid=50, error=error, density_digits=16).orderBy("point").collect()
        worst = np.abs(np.array([r.density for r in got]) - exact).max()
        assert worst <= error / (h * np.sqrt(2 * np.pi)) + 1e-15
    # the cost follows the nodes in use
    assert [r.density for r in density.kde_binned(spark.range(5).selectExpr("2D AS x"), "x", grid=4).collect()] == [None] * 4
    assert density.kde_binned(spark.range(0).selectExpr("2D AS x"), "x", grid=4).count() == 0
