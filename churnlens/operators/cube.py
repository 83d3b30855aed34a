"""A mergeable cube of subscribers from which the aggregate reports are projected.

A cell holds all subscribers alike in tenure band, charge band, contract, internet service, payment
method, churn and segments (a bit mask): how many they are, and the sums and counts that means,
shares and revenues are made of.  The number of cells follows the categories and not the rows, so
the subscribers are read once, combined in each task before the one shuffle, and every report is
made from cells.  Cells of parts of the data (days, sources) add up to those of the whole
(:func:`merged`).

:func:`totals` turns cells into one row per value of each dimension, again in one pass; the
projections below and the report take their figures from those rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bands import (CHARGE_EDGES, CHARGE_LABELS, TENURE_EDGES, TENURE_LABELS, band_label_sql,
                               band_ordinal_sql)
from ..functions.rounding import money_sql, round_ratio_sql
from ..functions.sql import quote
from .segments import SEGMENTS

DIMENSIONS = ("tenure_band", "charge_band", "contract", "internet", "payment", "churn", "segments")
#: What is summed over the subscribers of a cell (SQL over a clean subscriber row).
MEASURES = {
    "customers": "count(1)", "ids": "count(customerID)", "churned": "coalesce(sum(Churn), 0)", "churn_known": "count(Churn)",
    "tenure_sum": "coalesce(sum(tenure), 0)", "tenure_known": "count(tenure)",
    "monthly_sum": f"coalesce(sum({money_sql('MonthlyCharges')}), 0)", "monthly_known": f"count({money_sql('MonthlyCharges')})",
    "total_sum": f"coalesce(sum({money_sql('TotalCharges')}), 0)", "total_known": f"count({money_sql('TotalCharges')})",
}
_TYPES = {m: "DECIMAL(38,10)" if m in ("monthly_sum", "total_sum") else "BIGINT" for m in MEASURES}
#: Bit of each segment in a mask, by ordinal.
BITS = {s.ordinal: 1 << (s.ordinal - 1) for s in SEGMENTS}


def mask_sql() -> str:
    """SQL: the segments of a subscriber as a bit mask."""
    return " + ".join(f"CASE WHEN {s.predicate} THEN {BITS[s.ordinal]} ELSE 0 END" for s in SEGMENTS)


def subscriber_cube(subs: DataFrame) -> DataFrame:
    """The cells of clean subscribers; values that are NULL (or outside all bands) form cells too."""
    rows = subs.selectExpr(
        f"{band_ordinal_sql('tenure', TENURE_EDGES)} AS tenure_band",
        f"{band_ordinal_sql('MonthlyCharges', CHARGE_EDGES)} AS charge_band", "Contract AS contract",
        "InternetService AS internet", "PaymentMethod AS payment", "Churn AS churn", f"{mask_sql()} AS segments",
        "customerID", "tenure", "MonthlyCharges", "TotalCharges")
    return rows.groupBy(*DIMENSIONS).agg(*[F.expr(f"CAST({e} AS {_TYPES[m]}) AS {m}") for m, e in MEASURES.items()])


def merged(*cubes: DataFrame) -> DataFrame:
    """The cube of all that the given cubes cover, if no subscriber is in two of them."""
    every = reduce(DataFrame.unionByName, cubes)
    return every.groupBy(*DIMENSIONS).agg(*[F.expr(f"CAST(sum({m}) AS {_TYPES[m]}) AS {m}") for m in MEASURES])


def totals(cube: DataFrame) -> DataFrame:
    """(dimension, key) and the measures summed over its cells, with ``all`` for the whole (one
    row, also of an empty cube), and ``in_segment``, the customers of each segment.

    ``gone`` counts the customers whose churn is 1.  NULL keys are left out."""
    nothing = cube.sparkSession.range(1).selectExpr(
        *[f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in cube.schema if f.name in DIMENSIONS],
        *[f"CAST(0 AS {_TYPES[m]}) AS {m}" for m in MEASURES])
    dims = ", ".join(f"CASE WHEN {d} IS NOT NULL THEN named_struct('dimension', '{d}', 'key', CAST({d} AS STRING)) END"
                     for d in DIMENSIONS)
    cells = cube.select(*nothing.columns).union(nothing).selectExpr(
        "*", f"inline(array_compact(array(named_struct('dimension', 'all', 'key', ''), {dims})))")
    held = ", ".join(f"sum(CASE WHEN segments & {b} > 0 THEN customers ELSE 0 END)" for b in BITS.values())
    return cells.groupBy("dimension", "key").agg(
        *[F.expr(f"CAST(sum({m}) AS {_TYPES[m]}) AS {m}") for m in MEASURES],
        F.expr("CAST(sum(CASE WHEN churn = 1 THEN customers ELSE 0 END) AS BIGINT) AS gone"),
        F.expr(f"array({held}) AS in_segment"))


def _one(found: DataFrame, dimension: str) -> DataFrame:
    return found.where(F.col("dimension") == dimension)


def _mean(measure: str, digits: int = 2) -> str:
    return round_ratio_sql(f"{measure}_sum", f"{measure}_known", digits)


def _cents(measure: str) -> str:
    return f"coalesce({round_ratio_sql(f'{measure}_sum', '1', 2)}, 0.0D)"


#: The key figures as SQL over the ``all`` row of :func:`totals`.
KPIS = {
    "total_customers": "customers", "churn_count": "churned",
    "churn_rate": round_ratio_sql("churned * 100", "customers", 2),
    "arpu": _mean("monthly"), "clv": _mean("total"), "active_customers": "customers - churned",
}


def kpis(cube: DataFrame) -> DataFrame:
    """As :func:`operators.kpi.kpis`, from cells."""
    return _one(totals(cube), "all").selectExpr(*[f"{e} AS {c}" for c, e in KPIS.items()])


def churn_by_tenure(cube: DataFrame) -> DataFrame:
    """As :func:`operators.breakdowns.churn_by_tenure`, from cells."""
    return _one(totals(cube), "tenure_band").selectExpr(
        f"{band_label_sql('CAST(key AS INT)', TENURE_LABELS)} AS tenure_band", "CAST(key AS INT) AS ordinal",
        f"{round_ratio_sql('churned * 100', 'churn_known', 2)} AS churn_rate", "ids AS customers")


def revenue_by_band(cube: DataFrame) -> DataFrame:
    """As :func:`operators.breakdowns.revenue_by_band`, from cells."""
    return _one(totals(cube), "charge_band").selectExpr(
        f"{band_label_sql('CAST(key AS INT)', CHARGE_LABELS)} AS segment", "CAST(key AS INT) AS ordinal",
        f"{_cents('total')} AS revenue", "ids AS customers")


def retention_by_offer(cube: DataFrame) -> DataFrame:
    """As :func:`operators.breakdowns.retention_by_offer`, from cells."""
    return _one(totals(cube), "contract").selectExpr(
        "key AS offer", f"{round_ratio_sql('(churn_known - churned) * 100', 'churn_known', 2)} AS retention_rate",
        "ids AS customers")


def overview_summary(cube: DataFrame) -> DataFrame:
    """As :func:`operators.overview.overview_summary`, from cells."""
    return _one(totals(cube), "all").selectExpr(
        "customers AS total_customers", "churned AS churned_customers", "customers - churned AS active_customers",
        f"coalesce({KPIS['churn_rate']}, 0.0) AS churn_rate", f"{_mean('tenure', 1)} AS average_tenure",
        f"{_mean('monthly')} AS average_monthly_charges", f"{_cents('total')} AS total_revenue",
        f"coalesce({round_ratio_sql('total_sum', '1000000', 1)}, 0.0) AS total_revenue_millions")


def value_distributions(cube: DataFrame) -> DataFrame:
    """As :func:`operators.overview.value_distributions`, from cells."""
    names = {"contract": "Contract", "internet": "InternetService", "payment": "PaymentMethod"}
    named = " ".join(f"WHEN '{d}' THEN {quote(n)}" for d, n in names.items())
    rows = totals(cube).where(F.col("dimension").isin(*names))
    return rows.selectExpr(
        f"CASE dimension {named} END AS dimension", "key", "customers",
        "row_number() OVER (PARTITION BY dimension ORDER BY customers DESC, key) AS rank")


def segment_overlaps(subs: DataFrame) -> DataFrame:
    """The pairs of segments: first, second (by ordinal), their names, how many customers are in
    both, and the share of the customers of either that are in both (percent, 1 dp; NULL if neither
    has any).

    One aggregate over the masks (64 at most) gives all pairs."""
    by_mask = subs.selectExpr(f"{mask_sql()} AS m").groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    pairs = [(a, b) for a in SEGMENTS for b in SEGMENTS if a.ordinal < b.ordinal]
    both = {(a, b): BITS[a.ordinal] | BITS[b.ordinal] for a, b in pairs}
    wide = by_mask.agg(
        *[F.expr(f"coalesce(sum(CASE WHEN m & {v} = {v} THEN n END), 0) AS b{a.ordinal}_{b.ordinal}") for (a, b), v in both.items()],
        *[F.expr(f"coalesce(sum(CASE WHEN m & {v} > 0 THEN n END), 0) AS e{a.ordinal}_{b.ordinal}") for (a, b), v in both.items()])
    rows = ", ".join(
        f"named_struct('first', {a.ordinal}, 'second', {b.ordinal}, 'first_segment', {quote(a.name)}, 'second_segment', "
        f"{quote(b.name)}, 'customers', b{a.ordinal}_{b.ordinal}, 'either', e{a.ordinal}_{b.ordinal})" for a, b in pairs)
    return wide.selectExpr(f"inline(array({rows}))").selectExpr(
        "first", "second", "first_segment", "second_segment", "customers",
        f"{round_ratio_sql('customers * 100', 'either', 1)} AS share")
