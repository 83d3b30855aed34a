"""Hand-made unit rows at every threshold (bands, coercion, segments, reasons, empty input)."""

from __future__ import annotations

import decimal

from pyspark.sql import functions as F

from churnlens.functions.rounding import round_ratio
from churnlens.operators import breakdowns, clean, kpi, overview, reasons, segments
from churnlens.schema import RAW_SCHEMA, SUBSCRIBER_COLUMNS
from helpers import make_subs


def test_tenure_bands_right_closed(spark):
    tenures = [0, 1, 6, 7, 12, 13, 24, 25, 36, 37, 48, 49, 60, 61, 72, 73, None]
    df = make_subs(spark, [{"tenure": t, "Churn": i % 2} for i, t in enumerate(tenures)])
    got = {r.tenure_band: r.customers for r in breakdowns.churn_by_tenure(df).collect()}
    # 0, 73 and NULL are outside every band; each band has its two boundary rows
    assert got == {"0-6": 2, "7-12": 2, "13-24": 2, "25-36": 2, "37-48": 2, "49-60": 2, "61-72": 2}
    assert sum(got.values()) + 3 == len(tenures)


def test_charge_bands_right_closed(spark):
    charges = [0.0, 30.0, 30.01, 50.0, 50.01, 70.0, 70.01, 90.0, 90.01, 120.0, 120.01, None]
    df = make_subs(spark, [{"MonthlyCharges": c, "TotalCharges": 1.0} for c in charges])
    got = {r.segment: (r.customers, r.revenue) for r in breakdowns.revenue_by_band(df).collect()}
    assert got == {"Basic": (1, 1.0), "Standard": (2, 2.0), "Plus": (2, 2.0), "Premium": (2, 2.0),
                   "Enterprise": (2, 2.0)}


def test_empty_bands_absent(spark):
    df = make_subs(spark, [{"tenure": 3}, {"tenure": 3}])
    rows = breakdowns.churn_by_tenure(df).collect()
    assert [(r.tenure_band, r.ordinal, r.customers) for r in rows] == [("0-6", 1, 2)]


def test_coercion_and_churn_map(spark):
    values = [(" ", "Yes"), ("", "No"), ("abc", "maybe"), ("12.5", None), (None, "Yes")]
    rows = []
    for i, (tc, ch) in enumerate(values):
        d = {c: None for c in SUBSCRIBER_COLUMNS}
        d.update(customerID=f"X{i}", TotalCharges=tc, Churn=ch, MonthlyCharges=10.0, tenure=1)
        rows.append(tuple(d[c] for c in SUBSCRIBER_COLUMNS))
    raw = spark.createDataFrame(rows, RAW_SCHEMA)
    zero = clean.clean_subscribers(raw, "zero").orderBy("customerID").collect()
    assert [r.TotalCharges for r in zero] == [0.0, 0.0, 0.0, 12.5, 0.0]
    assert [r.Churn for r in zero] == [1, 0, None, None, 1]
    med = clean.clean_subscribers(raw, "median").orderBy("customerID").collect()
    assert [r.TotalCharges for r in med] == [12.5, 12.5, 12.5, 12.5, 12.5]


def test_median_interpolates(spark):
    raw = spark.createDataFrame(
        [tuple({"customerID": f"m{i}", "TotalCharges": v}.get(c) for c in SUBSCRIBER_COLUMNS)
         for i, v in enumerate(["10.00", "20.01", "x", "30.00", "40.00"])], RAW_SCHEMA)
    got = clean.clean_subscribers(raw, "median").where("customerID = 'm2'").first().TotalCharges
    assert got == (2001 + 3000) / 200


def test_kpi_denominators(spark):
    # churn rate divides by all rows (NULL Churn included), means skip NULLs
    df = make_subs(spark, [{"Churn": 1, "MonthlyCharges": 10.0}, {"Churn": 0, "MonthlyCharges": None},
                           {"Churn": None, "MonthlyCharges": 20.0}])
    r = kpi.kpis(df).first()
    assert (r.total_customers, r.churn_count, r.active_customers) == (3, 1, 2)
    assert r.churn_rate == 33.33 and r.arpu == 15.0
    c = kpi.churn_rate(df).first()
    assert c.churn_rate_2dp == 50.0


def test_segments_overlap_and_boundaries(spark):
    rows = [
        {"MonthlyCharges": 90.0, "tenure": 25},                       # not premium (charge 90)
        {"MonthlyCharges": 90.01, "tenure": 25},                      # premium
        {"MonthlyCharges": 95.0, "tenure": 24},                       # not premium (tenure 24)
        {"MonthlyCharges": 39.99, "InternetService": "Fiber optic",
         "Contract": "Month-to-month", "tenure": 11},                 # low arpu + heavy + at-risk
        {"MonthlyCharges": 40.0, "Contract": "Month-to-month", "tenure": 12},  # in none
        {"Contract": "Two year", "tenure": 37},                       # loyal
        {"Contract": "Two year", "tenure": 36},                       # none
        {"InternetService": "No", "PhoneService": "Yes"},             # voice only
    ]
    df = make_subs(spark, rows)
    got = {r.name: r["count"] for r in segments.segment_counts(df).collect()}
    assert got == {"Premium Users": 1, "Heavy Data Users": 1, "Voice Only": 1, "Low ARPU": 1,
                   "At-Risk": 1, "Loyal Base": 1}
    members = segments.segment_members(df).groupBy("customerID").count()
    assert {r.customerID: r["count"] for r in members.collect()}["C0003"] == 3
    one = segments.segment_counts(df, name="Loyal Base").collect()
    assert len(one) == 1 and one[0].percentage == 12.5


def test_reasons_share_then_filter_and_topk(spark):
    rows = ([{"Churn": 1, "Contract": "Month-to-month", "InternetService": "No"}] * 3
            + [{"Churn": 1, "Contract": "One year", "InternetService": "DSL"}]
            + [{"Churn": 0, "Contract": "Two year"}])
    df = make_subs(spark, rows)
    got = [(r.rank, r.reason, r.percentage) for r in reasons.churn_reasons(df).collect()]
    # shares use all churned rows; "No" is removed after normalising
    assert got == [(1, "Contrat Month-to-month", 75.0), (2, "Contrat One year", 25.0),
                   (3, "Internet DSL", 25.0)]
    assert reasons.churn_reasons(df, k=1).count() == 1


def test_reasons_all_no_internet(spark):
    df = make_subs(spark, [{"Churn": 1, "InternetService": "No"}] * 2)
    got = [(r.category, r.percentage) for r in reasons.churn_reasons(df).collect()]
    assert got == [("Contract", 100.0)]


def test_reasons_more_than_k(spark):
    rows = [{"Churn": 1, "Contract": f"c{i:02d}", "InternetService": f"s{i:02d}"} for i in range(12)]
    out = reasons.churn_reasons(make_subs(spark, rows)).collect()
    assert len(out) == 10 and [r.rank for r in out] == list(range(1, 11))
    # equal shares: contracts first, then by name
    assert out[0].reason == "Contrat c00" and out[-1].category == "Contract"


def test_empty_table(spark):
    df = make_subs(spark, [{"tenure": 1}]).limit(0)
    k = kpi.kpis(df).first()
    assert k.total_customers == 0 and k.churn_rate is None and k.arpu is None
    o = overview.overview(df).first()
    assert o.churn_rate == 0.0 and o.total_revenue == 0.0 and o.average_tenure is None
    assert breakdowns.churn_by_tenure(df).count() == 0
    assert reasons.churn_reasons(df).count() == 0
    assert [r["count"] for r in segments.segment_counts(df).collect()] == [0] * 6
    assert overview.value_distributions(df).count() == 0


def test_overview_filters(spark):
    df = make_subs(spark, [{"Churn": 1, "tenure": 10}, {"Churn": 0, "tenure": 20},
                           {"Churn": 0, "tenure": 31}])
    assert overview.overview(df, customer_type="churned").first().total_customers == 1
    a = overview.overview(df, customer_type="active").first()
    assert (a.total_customers, a.average_tenure) == (2, 25.5)
    assert overview.overview(df, customer_type="other").first().total_customers == 3


def test_round_ratio_half_up(spark):
    import random
    rnd = random.Random(7)
    cases = [(5, 10, 0), (-5, 10, 0), (145, 1000, 2), (125, 1000, 2), (1, 3, 2), (2, 3, 1), (0, 7, 2)]
    cases += [(rnd.randint(-10**9, 10**9), rnd.randint(1, 10**6), rnd.randint(0, 3)) for _ in range(2000)]
    df = spark.createDataFrame(cases, "n long, d long, k int")
    got = [tuple(r) for r in df.select(
        "n", "d", "k", F.when(F.col("k") == 0, round_ratio(F.col("n"), F.col("d"), 0))
        .when(F.col("k") == 1, round_ratio(F.col("n"), F.col("d"), 1))
        .when(F.col("k") == 2, round_ratio(F.col("n"), F.col("d"), 2))
        .otherwise(round_ratio(F.col("n"), F.col("d"), 3)).alias("r")).collect()]
    for n, d, k, r in got:
        q = decimal.Decimal(n) / decimal.Decimal(d)
        want = float(q.quantize(decimal.Decimal(1).scaleb(-k), rounding=decimal.ROUND_HALF_UP))
        assert r == want, (n, d, k, r, want)
    assert spark.range(1).select(round_ratio(F.lit(1), F.lit(0), 2).alias("r")).first().r is None


def test_exact_median_between_sketched_bounds(spark):
    import random
    import statistics
    rnd = random.Random(11)
    for n, accuracy in [(1, 4), (2, 4), (101, 5), (400, 60), (999, 1000)]:
        vals = [round(rnd.uniform(-50, 500), 2) for _ in range(n)]
        vals += [123.45] * (n // 3)          # one value holds a third of the rows
        df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
        got = clean.exact_median(df, "x", accuracy=accuracy).first().median
        cents = sorted(round(v * 100) for v in vals)
        want = (cents[(len(cents) - 1) // 2] + cents[len(cents) // 2]) / 200
        assert got == want, (n, accuracy)
        assert abs(got - statistics.median(vals)) < 1e-9
    empty = spark.createDataFrame([(None,)], "x double")
    assert clean.exact_median(empty, "x").first().median is None


def test_nan_is_missing(spark):
    rows = []
    for i, (mc, tc) in enumerate([(float("nan"), "NaN"), (95.0, "10.00"), (float("nan"), " ")]):
        d = {c: None for c in SUBSCRIBER_COLUMNS}
        d.update(customerID=f"N{i}", MonthlyCharges=mc, TotalCharges=tc, tenure=30, Churn="No",
                 Contract="One year", InternetService="DSL", PhoneService="Yes")
        rows.append(tuple(d[c] for c in SUBSCRIBER_COLUMNS))
    subs = clean.clean_subscribers(spark.createDataFrame(rows, RAW_SCHEMA))
    got = subs.orderBy("customerID").collect()
    assert [r.TotalCharges for r in got] == [0.0, 10.0, 0.0]
    assert got[0].MonthlyCharges is None
    assert kpi.kpis(subs).first().arpu == 95.0
    seg = {r.name: r["count"] for r in segments.segment_counts(subs).collect()}
    assert seg["Premium Users"] == 1  # NaN charges are not "> 90"
    med = clean.clean_subscribers(spark.createDataFrame(rows, RAW_SCHEMA), "median")
    assert [r.TotalCharges for r in med.orderBy("customerID").collect()] == [10.0, 10.0, 10.0]


def test_reasons_topk_keeps_largest(spark):
    # 12 contract values with distinct shares: the top 3 must be the 3 largest
    rows = []
    for i in range(12):
        rows += [{"Churn": 1, "Contract": f"c{i:02d}", "InternetService": "No"}] * (i + 1)
    out = reasons.churn_reasons(make_subs(spark, rows), k=3).collect()
    assert [r.reason for r in out] == ["Contrat c11", "Contrat c10", "Contrat c09"]
    assert [r.rank for r in out] == [1, 2, 3]


def test_histogram_edges_match_numpy(spark):
    import numpy as np
    from churnlens.operators import density
    vals = [18.0, 21.4, 24.8, 30.0, 55.55, 119.99, 120.0, 21.39]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r["count"] for r in density.histogram(df, "x").orderBy("bin").collect()]
    want, _ = np.histogram(vals, bins=30)
    assert got == list(want)  # 21.4 and 24.8 sit exactly on edges 1 and 2
    const = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    rows = density.histogram(const, "x").orderBy("bin").collect()
    want_c, edges_c = np.histogram([5.0, 5.0], bins=30)
    assert [r["count"] for r in rows] == list(want_c)
    assert rows[0].bin_start == edges_c[0] and rows[-1].bin_end == edges_c[-1]


def test_kde_matches_numpy_brute_force(spark):
    import numpy as np
    from churnlens.operators import density
    from churnlens.plans.context import Workspace
    subs = Workspace(spark, "/root/testdata/sf0.001").subs
    x = np.array([r.MonthlyCharges for r in subs.select("MonthlyCharges").collect()])
    n = len(x)
    h = x.std(ddof=1) * n ** (-0.2)
    grid = np.linspace(x.min(), x.max(), 200)
    dens = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(axis=1) / (n * h * np.sqrt(2 * np.pi))
    got = sorted((r.point, r.x, r.density, r.count_density) for r in density.kde(subs, "MonthlyCharges").collect())
    assert len(got) == 200
    width = (x.max() - x.min()) / 30
    for (p, gx, gd, gc), wx, wd in zip(got, grid, dens):
        assert abs(gx - wx) < 1e-9 and abs(gd - wd) < 1e-9
        assert abs(gc - wd * n * width) < 1e-5


def test_money_is_rounded_once(spark):
    """Sub-cent values: sums and means are rounded after adding up, not before."""
    many = make_subs(spark, [{"MonthlyCharges": 100.0, "TotalCharges": 100.004}] * 1000)
    assert breakdowns.revenue_by_band(many).first().revenue == 100004.0
    assert overview.overview(many).first().total_revenue == 100004.0
    few = make_subs(spark, [{"MonthlyCharges": x} for x in (0.125, 0.125, 0.124)])
    assert kpi.kpis(few).first().arpu == 0.12
    ties = make_subs(spark, [{"MonthlyCharges": x} for x in (0.12, 0.13)])
    assert kpi.kpis(ties).first().arpu == 0.13  # half away from zero


def test_infinity_is_no_number(spark):
    rows = spark.createDataFrame([("Infinity",), ("-inf",), ("NaN",), ("3",)], "t string")
    got = [r.v for r in rows.select(clean.coerce_double(rows.t).alias("v")).collect()]
    assert got == [None, None, None, 3.0]
    raw = make_subs(spark, [{}, {}]).withColumn("TotalCharges", F.lit("Infinity")).withColumn("Churn", F.lit("No"))
    assert kpi.kpis(clean.clean_subscribers(raw)).first().clv == 0.0
    assert clean.clean_subscribers(raw, fill="median").select("TotalCharges").first()[0] is None


def test_median_with_an_outlier(spark):
    values = [k * 0.25 for k in range(2001)] + [1e13, -1e300, 1e-300]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    want = sorted(values)
    n = len(want)
    assert clean.exact_median(df, "x", accuracy=200).first().median == (want[(n - 1) // 2] + want[n // 2]) / 2


def test_constant_column_has_no_density(spark):
    from churnlens.operators import density
    rows = density.kde(make_subs(spark, [{}] * 5), "MonthlyCharges").collect()
    assert len(rows) == 200 and {r.density for r in rows} == {None}


def test_density_queries_scan_once(spark):
    from churnlens.operators import density
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    for out in (density.histogram(df, "o_totalprice"), density.kde(df, "o_totalprice")):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ReusedExchange") + plan.count("ReusedSubquery") >= 1
