"""Snapshots, quarantined input, appends by run, the region layout and the trend state."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from churnlens.operators import overview, scoring
from churnlens.plans import jobs, trends
from churnlens.plans.context import Workspace
from churnlens.schema import RAW_SCHEMA, SUBSCRIBER_COLUMNS
from churnlens.session import list_path, scratch_path
from churnlens.sources import io
from churnlens.sources.snapshots import SnapshotStore, named_sources, source_files
from helpers import SF_SMALL, make_subs


def _write_lines(spark, path, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)


def _csv(spark, n, path):
    row = dict.fromkeys(SUBSCRIBER_COLUMNS, "x") | dict(SeniorCitizen=0, MonthlyCharges=20.0, TotalCharges="40", Churn="No")
    rows = [tuple((row | dict(customerID=f"K{i}", tenure=i))[c] for c in SUBSCRIBER_COLUMNS) for i in range(n)]
    spark.createDataFrame(rows, RAW_SCHEMA).coalesce(1).write.mode("append").options(header="true").csv(path)


def test_changed_csv_is_seen_whole(spark):
    path, out = scratch_path(spark, "t-csv"), scratch_path(spark, "t-job")
    table = "customer_data_" + out.rsplit("-", 1)[-1]

    def run(run_id):
        paths = jobs.run_csv(spark, path, out, sections=["kpis"], table=table, run_id=run_id)
        spark.catalog.refreshTable(table)
        rows = spark.table(table).where(F.col("run_id") == run_id).count()
        return spark.read.parquet(paths["kpis"]).first().total_customers, rows

    _csv(spark, 40, path)
    assert run("a") == (40, 40)
    store = SnapshotStore(spark, f"{out}/store")
    first = store.newest()
    assert run("a") == (40, 40) and store.newest() == first  # the same files: the store serves
    _csv(spark, 20, path)
    assert run("b") == (60, 60)  # analyses and warehouse rows of one version
    assert spark.table(table).count() == 100 and store.newest().number == 2
    spark.sql(f"DROP TABLE {table}")


def test_failed_refresh_keeps_the_old_rows(spark):
    path = scratch_path(spark, "t-store")
    io.write_store(make_subs(spark, [{"tenure": 3}, {"tenure": 4}]), path)
    bad = make_subs(spark, [{"tenure": 9}]).withColumn("tenure", F.raise_error(F.lit("killed")).cast("int"))
    with pytest.raises(Exception, match="killed"):
        io.write_store(bad, path)
    assert sorted(r.tenure for r in io.read_store(spark, path).collect()) == [3, 4]
    # data that was written and never published
    make_subs(spark, [{"tenure": 7}]).write.parquet(f"{path}/data/half")
    assert io.read_store(spark, path).count() == 2 and io.store_has_rows(spark, path)
    io.write_store(make_subs(spark, [{"tenure": 5}]), path)
    assert [r.tenure for r in io.read_store(spark, path).collect()] == [5]
    store = SnapshotStore(spark, path)
    assert store.vacuum(keep=1) >= 2 and len(list_path(spark, f"{path}/data")) == 1
    assert [r.tenure for r in io.read_store(spark, path).collect()] == [5]


def test_a_reader_keeps_its_version(spark):
    path = scratch_path(spark, "t-store")
    io.write_store(make_subs(spark, [{"tenure": 3}]), path)
    held = io.read_store(spark, path)
    io.write_store(make_subs(spark, [{"tenure": 4}, {"tenure": 5}]), path)
    assert [r.tenure for r in held.collect()] == [3] and io.read_store(spark, path).count() == 2


def test_sources_are_compared_by_file(spark):
    path, root = scratch_path(spark, "t-src"), scratch_path(spark, "t-store")
    _write_lines(spark, path, ["a"])
    store = SnapshotStore(spark, root)
    assert store.newest() is None and not store.is_made_from(source_files(spark, path))
    store.write({"rows": spark.range(3)}, source_files(spark, path))
    assert store.is_made_from(source_files(spark, path)) and store.read().count() == 3
    _write_lines(spark, path, ["b"])
    assert not store.is_made_from(source_files(spark, path))
    assert not store.is_made_from(named_sources(spark))
    with pytest.raises(FileNotFoundError):
        SnapshotStore(spark, scratch_path(spark, "t-none")).read()


def test_unreadable_requests_keep_their_text(spark):
    path, out = scratch_path(spark, "t-json"), scratch_path(spark, "t-out")
    good = '{"customerID":"A","tenure":3,"voice_usage":5.0,"data_usage":1.0,"complaints":0,"contract_type":"prepaid"}'
    broken = ['{"customerID":"B","tenure":', "no json at all", good.replace('"tenure":3', '"tenure":"many"')]
    late = good.replace('"voice_usage":5.0', '"voice_usage":0.0').replace('"A"', '"C"')
    _write_lines(spark, path, [good, *broken, late])
    paths = jobs.score_file(spark, path, out)
    assert [r.customerID for r in spark.read.parquet(paths["scored"]).collect()] == ["A"]
    rejected = {tuple(r) for r in spark.read.parquet(paths["rejected"]).collect()}
    assert rejected == {(None, scoring.UNREADABLE, x) for x in broken} | {("C", "voice_usage: must be > 0", None)}


def test_unreadable_csv_rows_are_put_aside(spark):
    path, out = scratch_path(spark, "t-csv"), scratch_path(spark, "t-job")
    cells = {c: "x" for c in SUBSCRIBER_COLUMNS} | {"SeniorCitizen": "0", "tenure": "5", "MonthlyCharges": "9.5", "TotalCharges": " "}
    whole = ",".join(cells.values())
    bad = [",".join((cells | {"tenure": "five"}).values()), ",".join((cells | {"tenure": "", "MonthlyCharges": "a"}).values()), "x,y"]
    _write_lines(spark, path, [",".join(SUBSCRIBER_COLUMNS), whole, *bad])
    table = "customer_data_" + out.rsplit("-", 1)[-1]
    paths = jobs.run_csv(spark, path, out, sections=["kpis"], table=table)
    spark.sql(f"DROP TABLE {table}")
    found = {r.raw: r.reason for r in spark.read.parquet(paths["unreadable"]).collect()}
    assert set(found) == set(bad) and found[bad[0]] == "unreadable: tenure"
    assert found[bad[1]] == "unreadable: tenure, MonthlyCharges"
    assert spark.read.parquet(paths["kpis"]).first().total_customers == 1
    assert io.read_csv(spark, path).count() == 4  # as before without the column: cells are NULL


def test_a_repeated_run_replaces_its_rows(spark):
    loc = scratch_path(spark, "t-wh")
    name = "customer_data_" + loc.rsplit("-", 1)[-1]
    io.create_warehouse_table(spark, name, loc, by_run=True)
    rows = make_subs(spark, [{"Churn": 1}, {"Churn": 0}])
    for run_id, df in (("it's 1", rows), ("2", rows), ("it's 1", rows.where("Churn = 1"))):
        io.append_to_warehouse(df, name, run_id)
    assert sorted((r.run_id, r.Churn) for r in spark.table(name).collect()) == [("2", 0), ("2", 1), ("it's 1", 1)]
    spark.sql(f"DROP TABLE {name}")


def test_filtered_overview_reads_matching_folders_only(spark):
    ws, path = Workspace(spark, SF_SMALL), scratch_path(spark, "t-region")
    io.write_region_store(ws.subs_with_region, path)
    args = ("EUROPE", "1995-03-10", "1995-12-20")
    rows = io.read_region_store(spark, path, *args)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PartitionFilters"):]
    assert "region" in pushed[:400] and "signup_month" in pushed[:400] and "GreaterThanOrEqual(signup_date" in plan
    read = {r.f for r in rows.select(F.input_file_name().alias("f")).distinct().collect()}
    every = {r.f for r in io.read_region_store(spark, path).select(F.input_file_name().alias("f")).distinct().collect()}
    assert read and all("region=EUROPE/signup_month=1995-" in f for f in read) and len(read) < len(every) / 5
    want = overview.overview(ws.subs_with_region, region=args[0], date_start=args[1], date_end=args[2]).first()
    assert overview.overview_summary(rows).first() == want and want.total_customers > 0
    assert io.read_region_store(spark, path).count() == ws.subs_with_region.count()


def test_trend_state_equals_a_full_run(spark):
    orders = Workspace(spark, SF_SMALL).orders
    state = trends.TrendState(spark, scratch_path(spark, "t-trends"))
    early = F.col("o_orderdate") < "1996-05-17"
    assert state.update(orders.where(early), "one") and not state.update(orders, "one")
    assert sorted(state.monthly_trends().collect()) == sorted(trends.monthly_trends(orders.where(early)).collect())
    late = orders.where(~early)
    assert state.update(late.where("o_orderkey % 2 = 0"), "two") and state.update(late.where("o_orderkey % 2 = 1"), "three")
    assert state.batches() == {"one", "two", "three"}
    assert sorted(state.monthly_trends().collect()) == sorted(trends.monthly_trends(orders).collect())
    assert sorted(state.monthly_deltas().collect(), key=str) == sorted(trends.monthly_deltas(orders).collect(), key=str)
    # the new orders alone are read
    plan = state.monthly_trends()._jdf.queryExecution().executedPlan().toString()
    assert "orders.parquet" not in plan
