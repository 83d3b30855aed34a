"""Properties on the driver's data and every operator on an empty table."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens.operators import (breakdowns, clean, density, kpi, overview, profile, reasons,
                                 scoring, segments)
from churnlens.plans import report, trends
from churnlens.plans.context import Workspace
from helpers import SF_SMALL, make_requests, make_subs

SF = "/root/testdata/sf0.01"


def test_score_bounds_and_levels(spark):
    ws = Workspace(spark, SF)
    scored = scoring.score(scoring.valid_requests(ws.requests))
    r = scored.agg(F.min("score").alias("lo"), F.max("score").alias("hi"),
                   F.count_if((F.col("score") >= 70) != (F.col("risk_level") == "Élevé")).alias("bad"),
                   F.count_if(F.size("recommendations") == 0).alias("norec")).first()
    assert 5 <= r.lo and r.hi <= 100 and r.bad == 0 and r.norec == 0


def test_band_counts_plus_dropped_equal_total(spark):
    subs = Workspace(spark, SF).subs
    total = subs.count()
    banded = breakdowns.churn_by_tenure(subs).agg(F.sum("customers")).first()[0]
    dropped = subs.where("tenure IS NULL OR tenure <= 0 OR tenure > 72").count()
    assert banded + dropped == total
    charged = breakdowns.revenue_by_band(subs).agg(F.sum("customers")).first()[0]
    out = subs.where("MonthlyCharges IS NULL OR MonthlyCharges <= 0 OR MonthlyCharges > 120").count()
    assert charged + out == total


def test_shares_sum_to_100_before_filter(spark):
    shares = reasons.reason_shares(Workspace(spark, SF).subs)
    for r in shares.groupBy("category").agg(F.sum("percentage").alias("p")).collect():
        assert abs(r.p - 100.0) <= 0.05 * 3  # each share rounded to 0.1


def test_kpi_identity(spark):
    k = kpi.kpis(Workspace(spark, SF).subs).first()
    assert k.active_customers + k.churn_count == k.total_customers
    o = overview.overview(Workspace(spark, SF).subs).first()
    assert (o.total_customers, o.churned_customers) == (k.total_customers, k.churn_count)


def test_every_operator_on_empty_input(spark):
    subs = make_subs(spark, [{"tenure": 1}]).limit(0)
    reqs = make_requests(spark, [{}]).limit(0)
    orders = spark.createDataFrame([], "o_orderkey long, o_custkey long, o_totalprice double, "
                                       "o_orderdate timestamp_ntz")
    frames = [
        kpi.kpis(subs), kpi.churn_rate(subs), breakdowns.churn_by_tenure(subs),
        breakdowns.revenue_by_band(subs), breakdowns.retention_by_offer(subs),
        reasons.churn_reasons(subs), segments.segment_counts(subs), segments.segment_members(subs),
        overview.overview(subs, "active"), overview.value_distributions(subs),
        overview.contract_counts(subs), profile.head(subs), profile.structure_profile(subs),
        profile.null_profile(subs), density.histogram(subs, "MonthlyCharges"),
        density.kde(subs, "MonthlyCharges"), clean.exact_median(subs, "TotalCharges"),
        scoring.score(scoring.valid_requests(reqs)), scoring.rejected_requests(reqs),
        trends.monthly_trends(orders), trends.monthly_deltas(orders),
        report.report_sections(subs, orders), report.report_summary(subs),
    ]
    counts = [f.count() for f in frames]
    assert counts[0] == 1 and counts[2] == 0 and counts[6] == 6 and counts[7] == 0
    assert counts[14] == 30  # every histogram bin is listed, with count 0


def test_entry_uses_small_data():
    assert SF_SMALL.endswith("sf0.001")
