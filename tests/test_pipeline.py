"""Sources and sinks, read-through store, trends on hand-made orders, report, batch jobs."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from churnlens.plans import report, trends
from churnlens.schema import RAW_SCHEMA, SUBSCRIBER_COLUMNS
from churnlens.session import scratch_path
from churnlens.sources import io
from helpers import make_subs


def _raw(spark, totals):
    rows = []
    for i, tc in enumerate(totals):
        d = {c: "x" for c in SUBSCRIBER_COLUMNS}
        d.update(customerID=f"K{i}", SeniorCitizen=0, tenure=i, MonthlyCharges=29.85,
                 TotalCharges=tc, Churn="Yes" if i % 2 else "No")
        rows.append(tuple(d[c] for c in SUBSCRIBER_COLUMNS))
    return spark.createDataFrame(rows, RAW_SCHEMA)


def test_csv_roundtrip_keeps_blanks(spark):
    path = scratch_path(spark, "t-csv")
    io.write_csv(_raw(spark, [" ", "12.50", "abc"]), path)
    back = io.read_csv(spark, path).orderBy("customerID").collect()
    assert [r.TotalCharges for r in back] == [" ", "12.50", "abc"]
    assert back[0].MonthlyCharges == 29.85 and back[1].Churn == "Yes"


def test_store_read_through(spark):
    path = scratch_path(spark, "t-store")
    calls = []

    def derive():
        calls.append(1)
        return make_subs(spark, [{"tenure": 3}, {"tenure": 4}])

    assert not io.store_has_rows(spark, path)
    assert io.load_subscribers(spark, path, derive).count() == 2
    assert io.load_subscribers(spark, path, derive).count() == 2
    assert len(calls) == 1  # the second load is served by the store


def test_csv_columns_are_bound_by_name(spark):
    path = scratch_path(spark, "t-csv")
    raw = _raw(spark, ["1", "2"]).withColumn("Partner", F.lit("P")).withColumn("Dependents", F.lit("D"))
    order = [c for c in reversed(raw.columns)] + ["Extra"]
    io.write_csv(raw.withColumn("Extra", F.lit("e")).select(*order), path)
    back = io.read_csv(spark, path)
    assert back.columns == SUBSCRIBER_COLUMNS
    assert {(r.Partner, r.Dependents, r.MonthlyCharges) for r in back.collect()} == {("P", "D", 29.85)}
    short = scratch_path(spark, "t-csv")
    io.write_csv(raw.drop("Partner"), short)
    with pytest.raises(ValueError, match="Partner"):
        io.read_csv(spark, short)


def test_job_from_csv(spark):
    from churnlens.plans import jobs
    path, out = scratch_path(spark, "t-csv"), scratch_path(spark, "t-job")
    raw = _raw(spark, ["100.50", " ", "20"])
    io.write_csv(raw.select(*reversed(raw.columns)), path)
    table = "customer_data_" + out.rsplit("-", 1)[-1]
    paths = jobs.run_csv(spark, path, out, table=table)
    k = spark.read.parquet(paths["kpis"]).first()
    assert (k.total_customers, k.churn_count, k.arpu, k.clv) == (3, 1, 29.85, 40.17)
    sections = {r.section for r in spark.read.parquet(paths["report"]).select("section").distinct().collect()}
    assert "trends" not in sections and {"header", "summary", "kpis", "segments"} <= sections
    assert spark.table(table).count() == 3
    spark.sql(f"DROP TABLE {table}")


def test_appended_input_is_seen_in_the_same_session(spark):
    import __spark_entry__ as E
    from helpers import SF_SMALL
    root = scratch_path(spark, "t-grow")
    for name in ("customer", "orders", "events", "nation", "region"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").write.parquet(f"{root}/{name}.parquet")
    query = E.queries()["kpis"]
    before = query(spark, root).first().total_customers
    spark.read.parquet(f"{SF_SMALL}/customer.parquet").write.mode("append").parquet(f"{root}/customer.parquet")
    assert query(spark, root).first().total_customers == 2 * before


def test_entry_without_a_checkpoint_folder():
    """A session without any setting runs the flagship query and finds a shared folder."""
    import os
    import subprocess
    import sys
    code = ("from pyspark.sql import SparkSession; import __spark_entry__ as E; "
            "from churnlens.session import scratch_path; "
            "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate(); "
            "assert E.entry(s).count() == 6; p = scratch_path(s, 'x'); s.range(3).write.parquet(p); "
            "assert s.read.parquet(p).count() == 3")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_warehouse_append_and_pushdown(spark):
    loc = scratch_path(spark, "t-wh")
    name = "customer_data_" + loc.rsplit("-", 1)[-1]
    io.create_warehouse_table(spark, name, loc)
    io.create_warehouse_table(spark, name, loc)  # IF NOT EXISTS
    rows = make_subs(spark, [{"Churn": 1}, {"Churn": 0}, {"Churn": 1}])
    io.append_to_warehouse(rows, name)
    io.append_to_warehouse(rows, name)  # no key: appended twice
    assert io.scan_warehouse(spark, name).count() == 6
    churned = io.scan_warehouse(spark, name, "Churn = 1")
    assert churned.count() == 4
    plan = churned._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(Churn,1)" in plan
    spark.sql(f"DROP TABLE {name}")


def _orders(spark, rows):
    return spark.createDataFrame(
        [(i, c, p, dt.datetime.fromisoformat(d)) for i, (c, d, p) in enumerate(rows)],
        "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz")


def test_monthly_trends_semantics(spark):
    orders = _orders(spark, [
        (1, "2020-01-05", 10.0), (1, "2020-01-20", 5.5),   # A: new Jan, churned (last Jan)
        (2, "2020-01-10", 1.0), (2, "2020-12-30", 2.0),    # B: new Jan, active
        (3, "2020-02-03", 3.25),                           # C: new Feb, churned (last Feb)
        (4, "2020-12-31", 4.0),                            # D: new Dec, snapshot
    ])
    got = {r.month.isoformat(): r for r in trends.monthly_trends(orders).collect()}
    jan, feb, dec = got["2020-01-01"], got["2020-02-01"], got["2020-12-01"]
    assert (jan.new_customers, jan.churned_customers, jan.base_customers) == (2, 1, 2)
    assert jan.churn_rate == 50.0 and jan.revenue == 16.5
    # Feb: acquired up to Feb = 3, churned before Feb = 1 -> base 2, one churned
    assert (feb.new_customers, feb.churned_customers, feb.base_customers, feb.churn_rate) == (1, 1, 2, 50.0)
    assert (dec.new_customers, dec.churned_customers, dec.base_customers) == (1, 0, 2)
    deltas = {r.month.isoformat(): r for r in trends.monthly_deltas(orders).collect()}
    assert deltas["2020-01-01"].revenue_change_pct is None
    assert deltas["2020-02-01"].revenue_change_pct == -80.3   # 3.25 vs 16.50
    assert deltas["2020-02-01"].new_customers_delta == -1
    # March has no orders: a row of zeros, and nothing to compare April's revenue with
    mar = got["2020-03-01"]
    assert (mar.new_customers, mar.churned_customers, mar.base_customers, mar.revenue, mar.churn_rate) == (0, 0, 1, 0.0, 0.0)
    assert deltas["2020-03-01"].revenue_change_pct == -100.0 and deltas["2020-03-01"].churn_rate_delta == -50.0
    assert deltas["2020-04-01"].revenue_change_pct is None
    assert deltas["2020-12-01"].revenue_change_pct is None and deltas["2020-12-01"].new_customers_delta == 1
    assert len(got) == 12


def test_monthly_figures_at_scale(spark):
    """Monthly revenue of about 10^16: percentages neither overflow nor lose cents."""
    orders = _orders(spark, [(1, "2020-01-05", 4e15), (2, "2020-01-06", 4e15), (1, "2020-02-05", 1.2e16)])
    got = [r.revenue_change_pct for r in trends.monthly_deltas(orders).orderBy("month").collect()]
    assert got == [None, 50.0]


def test_report_sections_and_partitioned_write(spark):
    subs = make_subs(spark, [{"Churn": 1, "tenure": 3}, {"Churn": 0, "tenure": 30}])
    orders = _orders(spark, [(1, "2020-01-05", 10.0)])
    only_kpis = report.report_sections(subs, orders, include_sections=["kpis"])
    assert {r.section for r in only_kpis.select("section").distinct().collect()} == {
        "header", "summary", "kpis", "contracts", "recommendations"}
    full = report.report_sections(subs, orders, report_date="2024-03-09")
    head = full.where("section = 'header'").first()
    assert (head.label, head.text) == ("Rapport Telco Analytics", "Généré le 09/03/2024")
    risk = full.where("section = 'segments' AND label = 'At-Risk'").first()
    assert risk.text.startswith("0 | Contrat mensuel") and "Appel proactif" in risk.text
    assert {r.section for r in full.select("section").distinct().collect()} == {
        "header", "summary", "kpis", "churn", "segments", "trends", "contracts", "recommendations"}
    path = scratch_path(spark, "t-report")
    report.write_report(full, path)
    kp = spark.read.parquet(path).where("section = 'kpis'")
    assert kp.count() == 6
    summary = report.report_summary(subs).first().summary
    assert summary.startswith("Ce rapport") and " 2 clients" in summary and "50.0%" in summary


def test_views_and_batch_job(spark):
    from churnlens.plans import jobs
    from churnlens.plans.context import Workspace
    from helpers import SF_SMALL
    ws = Workspace(spark, SF_SMALL)
    names = ws.register_views(prefix="t_")
    assert names == ["t_raw", "t_subs", "t_subs_dim", "t_score_requests"]
    churned = spark.sql("SELECT * FROM t_subs WHERE Churn = 1").count()
    assert churned == ws.subs.where("Churn = 1").count() > 0
    out = scratch_path(spark, "t-job")
    loc = out.rsplit("-", 1)[-1]
    paths = jobs.run_batch(spark, SF_SMALL, out, table=f"customer_data_{loc}")
    assert spark.read.parquet(paths["kpis"]).count() == 1
    assert spark.read.parquet(paths["report"]).select("section").distinct().count() == 8
    assert spark.table(f"customer_data_{loc}").count() == ws.raw.count()
    spark.sql(f"DROP TABLE customer_data_{loc}")


def test_attach_dimension_matches_single_pass(spark):
    from churnlens.operators import overview
    from churnlens.plans.context import Workspace
    from helpers import SF_SMALL
    ws = Workspace(spark, SF_SMALL)
    args = dict(region="EUROPE", date_start="1995-03-01", date_end="1995-12-31")
    joined = overview.overview(overview.attach_dimension(ws.subs, ws.dim), **args).first()
    single = overview.overview(ws.subs_with_region, **args).first()
    assert joined == single and joined.total_customers > 0
    with pytest.raises(ValueError):
        overview.overview(ws.subs, region="EUROPE")


def test_tune_for_input(spark):
    from churnlens.session import tune_for_input
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        parts = tune_for_input(spark, ["/root/testdata/sf0.01/orders.parquet"], target_bytes=64 << 10)
        assert parts >= 2 * spark.sparkContext.defaultParallelism
        # no cap: the partitions follow the input
        many = tune_for_input(spark, ["/root/testdata/sf0.01/orders.parquet"], target_bytes=1 << 10)
        assert many >= 200
        parts = tune_for_input(spark, ["/root/testdata/sf0.01/orders.parquet"], target_bytes=64 << 10)
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(parts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
