"""Named queries: each takes (spark, data_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import (breakdowns, clean, cube, density, kpi, overview, profile, reasons, scoring,
                         segments)
from ..schema import WAREHOUSE_COLUMNS
from ..session import scratch_path
from ..sources import io
from ..streaming import scoring_stream
from . import report, trends
from .context import Workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
        QUERIES[name] = lambda spark, data_dir: fn(Workspace(spark, data_dir))
        return fn
    return deco


@register("kpis")
def q_kpis(ws: Workspace) -> DataFrame:
    return kpi.kpis(ws.subs)


@register("churn_rate")
def q_churn_rate(ws: Workspace) -> DataFrame:
    return kpi.churn_rate(ws.subs)


@register("churn_by_tenure")
def q_churn_by_tenure(ws: Workspace) -> DataFrame:
    return breakdowns.churn_by_tenure(ws.subs)


@register("revenue_by_band")
def q_revenue_by_band(ws: Workspace) -> DataFrame:
    return breakdowns.revenue_by_band(ws.subs)


@register("retention_by_offer")
def q_retention_by_offer(ws: Workspace) -> DataFrame:
    return breakdowns.retention_by_offer(ws.subs)


@register("churn_reasons")
def q_churn_reasons(ws: Workspace) -> DataFrame:
    return reasons.churn_reasons(ws.subs, k=10)


@register("churn_reasons_top5")
def q_churn_reasons_top5(ws: Workspace) -> DataFrame:
    return reasons.churn_reasons(ws.subs, k=5)


def _flat_segments(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "characteristics": F.array_join("characteristics", " | "),
        "actions": F.array_join("actions", " | "),
    })


@register("segments")
def q_segments(ws: Workspace) -> DataFrame:
    return _flat_segments(segments.segment_counts(ws.subs))


@register("segment_members")
def q_segment_members(ws: Workspace) -> DataFrame:
    return segments.segment_members(ws.subs)


@register("overview")
def q_overview(ws: Workspace) -> DataFrame:
    return overview.overview(ws.subs)


@register("overview_active")
def q_overview_active(ws: Workspace) -> DataFrame:
    return overview.overview(ws.subs, customer_type="active")


@register("overview_churned")
def q_overview_churned(ws: Workspace) -> DataFrame:
    return overview.overview(ws.subs, customer_type="churned")


# Parameters of the filtered overview (region name and signup date range).
FILTER_REGION = "EUROPE"
FILTER_START = "1995-03-01"
FILTER_END = "1995-12-31"


@register("overview_filtered")
def q_overview_filtered(ws: Workspace) -> DataFrame:
    return overview.overview(ws.subs_with_region, region=FILTER_REGION,
                             date_start=FILTER_START, date_end=FILTER_END)


@register("distributions")
def q_distributions(ws: Workspace) -> DataFrame:
    return overview.value_distributions(ws.subs)


@register("contract_counts")
def q_contract_counts(ws: Workspace) -> DataFrame:
    return overview.contract_counts(ws.subs)


@register("score_requests")
def q_score_requests(ws: Workspace) -> DataFrame:
    return ws.requests


def _scored(ws: Workspace) -> DataFrame:
    return scoring.score(scoring.valid_requests(ws.requests))


@register("score_batch")
def q_score_batch(ws: Workspace) -> DataFrame:
    return _scored(ws).select("customerID", "raw_score", "score", "probability", "risk_level")


@register("score_factors")
def q_score_factors(ws: Workspace) -> DataFrame:
    return scoring.factor_rows(_scored(ws))


@register("score_recommendations")
def q_score_recommendations(ws: Workspace) -> DataFrame:
    return scoring.recommendation_rows(_scored(ws))


@register("score_rejects")
def q_score_rejects(ws: Workspace) -> DataFrame:
    return scoring.rejected_requests(ws.requests)


@register("clean_zero")
def q_clean_zero(ws: Workspace) -> DataFrame:
    return ws.subs


@register("clean_median")
def q_clean_median(ws: Workspace) -> DataFrame:
    return ws.warehouse


@register("head")
def q_head(ws: Workspace) -> DataFrame:
    return profile.head(ws.subs, 5)


@register("structure_profile")
def q_structure_profile(ws: Workspace) -> DataFrame:
    return profile.structure_profile(ws.raw)


@register("null_profile")
def q_null_profile(ws: Workspace) -> DataFrame:
    return profile.null_profile(ws.raw)


@register("churned_customers")
def q_churned_customers(ws: Workspace) -> DataFrame:
    """SELECT * FROM the warehouse table WHERE Churn = 1: the table is created and loaded first, and
    the predicate is pushed into the scan of its files."""
    name, location = _loaded_warehouse(ws)
    return io.scan_then_drop(ws.spark, name, location, "Churn = 1")


@register("charge_histogram")
def q_charge_histogram(ws: Workspace) -> DataFrame:
    return density.histogram(ws.subs, "MonthlyCharges", bins=30)


@register("charge_kde")
def q_charge_kde(ws: Workspace) -> DataFrame:
    return density.kde(ws.subs, "MonthlyCharges", grid=200, hist_bins=30)


@register("monthly_trends")
def q_monthly_trends(ws: Workspace) -> DataFrame:
    return trends.monthly_trends(ws.orders)


@register("kpi_monthly_delta")
def q_kpi_monthly_delta(ws: Workspace) -> DataFrame:
    return trends.monthly_deltas(ws.orders)


@register("csv_roundtrip")
def q_csv_roundtrip(ws: Workspace) -> DataFrame:
    """Raw table -> CSV files -> schema'd CSV read -> cleaning."""
    path = scratch_path(ws.spark, "csv")
    io.write_csv(ws.raw, path)
    return clean.clean_subscribers(io.read_csv(ws.spark, path), fill="zero")


@register("store_roundtrip")
def q_store_roundtrip(ws: Workspace) -> DataFrame:
    """Read-through load on an empty store: derive + clean, write, read back; the second
    load is served by the store."""
    path = scratch_path(ws.spark, "store")
    io.load_subscribers(ws.spark, path, lambda: ws.subs)
    return io.load_subscribers(ws.spark, path, lambda: ws.subs)


def _loaded_warehouse(ws: Workspace) -> tuple[str, str]:
    """A warehouse table of its own with the batch-pipeline rows: (table, location)."""
    location = scratch_path(ws.spark, "warehouse")
    name = "customer_data_" + location.rsplit("-", 1)[-1]
    io.create_warehouse_table(ws.spark, name, location)
    io.append_to_warehouse(ws.warehouse, name)
    return name, location


@register("warehouse_append")
def q_warehouse_append(ws: Workspace) -> DataFrame:
    """CREATE TABLE IF NOT EXISTS, append the batch-pipeline rows, full scan."""
    name, location = _loaded_warehouse(ws)
    return io.scan_then_drop(ws.spark, name, location)


@register("score_stream")
def q_score_stream(ws: Workspace) -> DataFrame:
    """Requests written as files, scored by a Structured Streaming query (availableNow)."""
    root = scratch_path(ws.spark, "stream")
    ws.requests.write.mode("overwrite").parquet(f"{root}/requests")
    query = scoring_stream.start_scoring_stream(ws.spark, f"{root}/requests", f"{root}/out",
                                                f"{root}/checkpoint")
    query.awaitTermination()
    return scoring_stream.read_scored(ws.spark, f"{root}/out").select(
        "customerID", "raw_score", "score", "probability", "risk_level")


# The report's generation date (passed in, so that results repeat).
REPORT_DATE = "1998-12-31"


@register("report_sections")
def q_report_sections(ws: Workspace) -> DataFrame:
    return report.report_sections(ws.subs, ws.orders, report_date=REPORT_DATE)


@register("report_summary")
def q_report_summary(ws: Workspace) -> DataFrame:
    return report.report_summary(ws.subs)


@register("distributions_churned")
def q_distributions_churned(ws: Workspace) -> DataFrame:
    """Value distributions of the churned population (overview with customer_type=churned)."""
    return overview.value_distributions(overview.filter_subscribers(ws.subs, customer_type="churned"))


@register("segment_lookup")
def q_segment_lookup(ws: Workspace) -> DataFrame:
    """One segment by name (the detail view of a single segment)."""
    return _flat_segments(segments.segment_counts(ws.subs, name="At-Risk"))


@register("subscriber_cube")
def q_subscriber_cube(ws: Workspace) -> DataFrame:
    return cube.subscriber_cube(ws.subs).withColumns(
        {m: F.col(m).cast("double") for m in ("monthly_sum", "total_sum")})


@register("segment_overlaps")
def q_segment_overlaps(ws: Workspace) -> DataFrame:
    return cube.segment_overlaps(ws.subs)


@register("cube_overview")
def q_cube_overview(ws: Workspace) -> DataFrame:
    """The overview from the cubes of churned and of other subscribers, merged."""
    parts = [cube.subscriber_cube(ws.subs.where(c)) for c in ("Churn = 1", "Churn <> 1 OR Churn IS NULL")]
    return cube.overview_summary(cube.merged(*parts))


@register("overview_from_store")
def q_overview_from_store(ws: Workspace) -> DataFrame:
    """The filtered overview over a store laid out by region and signup month."""
    path = scratch_path(ws.spark, "region-store")
    io.write_region_store(ws.subs_with_region, path)
    rows = io.read_region_store(ws.spark, path, FILTER_REGION, FILTER_START, FILTER_END)
    return overview.overview_summary(rows)


@register("warehouse_rerun")
def q_warehouse_rerun(ws: Workspace) -> DataFrame:
    """A run appended twice under one id and another run: the table holds each once."""
    location = scratch_path(ws.spark, "warehouse")
    name = "customer_data_" + location.rsplit("-", 1)[-1]
    io.create_warehouse_table(ws.spark, name, location, by_run=True)
    rows = ws.subs.select(*WAREHOUSE_COLUMNS)
    for run_id, part in (("first", rows), ("second", rows.where("Churn = 1")), ("first", rows)):
        io.append_to_warehouse(part, name, run_id)
    return io.scan_then_drop(ws.spark, name, location)


@register("score_quarantine")
def q_score_quarantine(ws: Workspace) -> DataFrame:
    """Requests as lines of JSON, some cut short and some with a word for a number: the rejected
    ones with their reason and, where they cannot be read, their text."""
    path = scratch_path(ws.spark, "requests")
    columns = [c for c in ws.requests.columns]
    cut = F.concat(F.lit('{"customerID":"'), "customerID", F.lit('","tenure":'))
    line = (F.when(F.col("tenure") % 10 == 3, cut).when(F.col("tenure") % 10 == 7, F.concat(cut, F.lit('"many"}')))
            .otherwise(F.to_json(F.struct(*columns))))
    ws.requests.select(line.alias("value")).write.text(path)
    return scoring.rejected_requests(io.read_requests(ws.spark, path))


@register("csv_quarantine")
def q_csv_quarantine(ws: Workspace) -> DataFrame:
    """The subscribers as CSV, some rows with a word for a number: their text and what is lost."""
    path = scratch_path(ws.spark, "csv")
    last = F.col("tenure") % 10
    io.write_csv(ws.raw.withColumns({
        "tenure": F.when(last == 3, "many").otherwise(F.col("tenure").cast("string")),
        "MonthlyCharges": F.when(last == 7, "n/a").otherwise(F.col("MonthlyCharges").cast("string"))}), path)
    return io.unreadable_rows(io.read_csv(ws.spark, path, corrupt=True))


@register("trends_incremental")
def q_trends_incremental(ws: Workspace) -> DataFrame:
    """Monthly trends from a state that was given the orders in three batches, one of them twice."""
    state = trends.TrendState(ws.spark, scratch_path(ws.spark, "trends"))
    year = F.year("o_orderdate")
    for batch, part in (("to 1994", year <= 1994), ("to 1996", year.between(1995, 1996)), ("to 1994", year <= 1994),
                        ("after", year > 1996)):
        state.update(ws.orders.where(part), batch)
    return state.monthly_trends()


@register("price_kde")
def q_price_kde(ws: Workspace) -> DataFrame:
    """Density of the order totals, a column of almost as many values as rows."""
    return density.kde_binned(ws.orders, "o_totalprice", error=1e-7, density_digits=11, count_digits=3)


@register("score_stream_repeats")
def q_score_stream_repeats(ws: Workspace) -> DataFrame:
    """Requests delivered twice, scored by a stream that knows them by id; its batches compacted."""
    root = scratch_path(ws.spark, "stream")
    marked = ws.requests.select("*", F.col("customerID").alias(scoring_stream.REQUEST_ID),
                                F.expr("TIMESTAMP '1998-12-01 00:00:00' + make_dt_interval(0, tenure)").alias(scoring_stream.REQUESTED_AT))
    for _ in range(2):
        marked.write.mode("append").parquet(f"{root}/requests")
    scoring_stream.start_scoring_stream(ws.spark, f"{root}/requests", f"{root}/out", f"{root}/checkpoint",
                                        max_files_per_trigger=4, dedupe_within="30 days").awaitTermination()
    scoring_stream.compact(ws.spark, f"{root}/out")
    return scoring_stream.read_scored(ws.spark, f"{root}/out").select(
        "customerID", "raw_score", "score", "probability", "risk_level")
