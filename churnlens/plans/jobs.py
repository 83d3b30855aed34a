"""Batch job: derive or read subscribers, clean them, load the warehouse table, compute the
analyses and write every result as a table under one output folder.

    python -m churnlens.plans.jobs --data-dir DIR --out OUT [--sections kpis,churn,...]
    python -m churnlens.plans.jobs --csv FILE_OR_DIR --out OUT [--sections kpis,churn,...]
    python -m churnlens.plans.jobs --requests FILE_OR_DIR --format json --out OUT

Each result is a distributed write (Parquet); the report dataset is partitioned
by section.  Nothing is collected to the driver.
"""

from __future__ import annotations

import argparse

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..operators import breakdowns, clean, density, kpi, overview, reasons, scoring, segments
from ..sources import io
from ..sources.snapshots import SnapshotStore, source_files
from . import report, trends
from .context import Workspace


def _subscriber_results(subs: DataFrame) -> dict[str, DataFrame]:
    return {
        "kpis": kpi.kpis(subs),
        "churn_rate": kpi.churn_rate(subs),
        "churn_by_tenure": breakdowns.churn_by_tenure(subs),
        "revenue_by_band": breakdowns.revenue_by_band(subs),
        "retention_by_offer": breakdowns.retention_by_offer(subs),
        "churn_reasons": reasons.churn_reasons(subs),
        "segments": segments.segment_counts(subs),
        "overview": overview.overview(subs),
        "distributions": overview.value_distributions(subs),
        "charge_histogram": density.histogram(subs, "MonthlyCharges"),
        "charge_kde": density.kde(subs, "MonthlyCharges"),
    }


def _write(spark: SparkSession, raw: DataFrame, results: dict[str, DataFrame], sections: DataFrame,
           out: str, table: str, run_id: str | None = None) -> dict[str, str]:
    paths = {}
    for name, df in results.items():
        paths[name] = f"{out}/{name}"
        df.write.mode("overwrite").parquet(paths[name])
    paths["report"] = f"{out}/report"
    report.write_report(sections, paths["report"])
    # warehouse copy: batch-pipeline cleaning (median fill, no id), appended to a table
    paths[table] = f"{out}/{table}"
    io.create_warehouse_table(spark, table, paths[table], by_run=run_id is not None)
    io.append_to_warehouse(clean.warehouse_rows(raw), table, run_id)
    return paths


def run_batch(spark: SparkSession, data_dir: str, out: str,
              sections=report.DEFAULT_SECTIONS, table: str = "customer_data", run_id: str | None = None) -> dict[str, str]:
    """Write all analyses of ``data_dir`` under ``out``; returns {result name: path}.

    The warehouse table ``table`` is created if missing (at ``out/<table>``) and the
    cleaned rows are appended, as in the batch flow it mirrors: running the job twice
    against the same table appends twice.  With ``run_id`` the table keeps which run appended a
    row, and a run that is repeated replaces its own rows.
    """
    ws = Workspace(spark, data_dir)
    # a dozen aggregations read the same clean table: derive it once, keep the clean rows
    # on the executors (spilling to disk; lost blocks are recomputed)
    subs = ws.subs.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        results = _subscriber_results(subs) | {
            "monthly_trends": trends.monthly_trends(ws.orders),
            "scored_requests": scoring.score(scoring.valid_requests(ws.requests)),
            "rejected_requests": scoring.rejected_requests(ws.requests),
        }
        return _write(spark, ws.raw, results, report.report_sections(subs, ws.orders, sections), out.rstrip("/"), table,
                      run_id)
    finally:
        subs.unpersist()


def run_csv(spark: SparkSession, csv: str, out: str, sections=report.DEFAULT_SECTIONS,
            table: str = "customer_data", run_id: str | None = None) -> dict[str, str]:
    """Write all analyses of a subscriber CSV (header bound by name) under ``out``.

    The rows go through the store ``out/store``: a later run reads the store as long as the files
    of the CSV are the same, and makes a new version otherwise.  All results of a run, the
    warehouse rows too, come from one version.  Rows that cannot be read are left out and listed
    with their text in ``unreadable``.  A CSV has no orders, so there are no trends and no scoring
    requests."""
    out = out.rstrip("/")
    store, files = SnapshotStore(spark, f"{out}/store"), source_files(spark, csv)
    if not store.is_made_from(files):
        rows = io.read_csv(spark, csv, corrupt=True)
        store.write({"rows": io.readable_rows(rows), "unreadable": io.unreadable_rows(rows)}, files)
    version = store.newest()
    raw = store.read(version=version)
    subs = clean.clean_subscribers(raw, fill="zero")
    rows = report.report_sections(subs, None, [s for s in sections if s != "trends"])
    results = _subscriber_results(subs) | {"unreadable": store.read("unreadable", version)}
    return _write(spark, raw, results, rows, out, table, run_id) | {"store": store.root}


def score_file(spark: SparkSession, path: str, out: str, fmt: str = "json") -> dict[str, str]:
    """Score a file (or folder) of requests with ``REQUEST_SCHEMA`` columns; write the
    scored rows (arrays and maps kept) and the rejected rows with their reason and, where they
    could not be read, their text."""
    requests = io.read_requests(spark, path, fmt)
    out = out.rstrip("/")
    paths = {"scored": f"{out}/scored", "rejected": f"{out}/rejected"}
    scoring.score(scoring.valid_requests(requests)).write.mode("overwrite").parquet(paths["scored"])
    scoring.rejected_requests(requests).write.mode("overwrite").parquet(paths["rejected"])
    return paths


def main(argv: list[str] | None = None) -> None:
    from ..session import get_session
    ap = argparse.ArgumentParser(description=__doc__.split("\n\n")[0].replace("\n", " "))
    ap.add_argument("--data-dir", help="folder of source tables (customer, orders, events, ...)")
    ap.add_argument("--csv", help="subscriber CSV (file or folder) instead of the source tables")
    ap.add_argument("--requests", help="score this file or folder of requests instead")
    ap.add_argument("--format", default="json", help="format of --requests: json, parquet, csv")
    ap.add_argument("--out", required=True)
    ap.add_argument("--sections", default=",".join(report.DEFAULT_SECTIONS))
    ap.add_argument("--run-id", help="a repeated run with this id replaces its own warehouse rows")
    ap.add_argument("--master", default=None)
    args = ap.parse_args(argv)
    if not (args.data_dir or args.csv or args.requests):
        ap.error("give --data-dir, --csv or --requests")
    spark = get_session(args.master)
    if args.requests:
        paths = score_file(spark, args.requests, args.out, args.format)
    elif args.csv:
        paths = run_csv(spark, args.csv, args.out, args.sections.split(","), run_id=args.run_id)
    else:
        paths = run_batch(spark, args.data_dir, args.out, args.sections.split(","), run_id=args.run_id)
    for name, path in paths.items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
