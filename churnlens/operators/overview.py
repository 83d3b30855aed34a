"""Filtered overview: summary figures and value distributions.

Filters are applied while the plan is built (``customer_type``, ``region``,
signup date range), so they reach the scan or the join as ordinary predicates.
The three value distributions share one scan through GROUPING SETS.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import mean_money, money_sql, round_ratio, round_ratio_sql, sum_money
from ..functions.sql import quote

DISTRIBUTION_COLUMNS = ("Contract", "InternetService", "PaymentMethod")


def filter_subscribers(subs: DataFrame, customer_type: str | None = None,
                       region: str | None = None, date_start: str | None = None,
                       date_end: str | None = None) -> DataFrame:
    """``customer_type``: 'churned' or 'active'; anything else means no filter.

    ``region`` and the signup range need ``region`` / ``signup_date`` columns
    (see :func:`attach_dimension`).
    """
    df = subs
    if customer_type == "churned":
        df = df.where(F.col("Churn") == 1)
    elif customer_type == "active":
        df = df.where(F.col("Churn") == 0)
    if region is not None or date_start is not None or date_end is not None:
        missing = {"region", "signup_date"} - set(df.columns)
        if missing:
            raise ValueError(f"region/date filters need columns {sorted(missing)}; use attach_dimension")
    if region is not None:
        df = df.where(F.col("region") == region)
    if date_start is not None:
        df = df.where(F.col("signup_date") >= F.lit(date_start).cast("date"))
    if date_end is not None:
        df = df.where(F.col("signup_date") <= F.lit(date_end).cast("date"))
    return df


def attach_dimension(subs: DataFrame, dim: DataFrame) -> DataFrame:
    """Add ``region`` and ``signup_date`` from a (customerID, region, signup_date) table."""
    return subs.join(dim.select("customerID", "region", "signup_date"), "customerID")


def overview_summary(df: DataFrame) -> DataFrame:
    """total, churned, active, churn_rate (2 dp; 0 when empty), mean tenure (1 dp),
    mean monthly charge (2 dp), total revenue (sum of TotalCharges, exact) and the
    same in millions (1 dp)."""
    churned = "CAST(coalesce(sum(Churn), 0) AS BIGINT)"
    revenue = f"sum({money_sql('TotalCharges')})"
    return df.agg(
        F.expr("count(1) AS total_customers"),
        F.expr(f"{churned} AS churned_customers"),
        F.expr(f"count(1) - {churned} AS active_customers"),
        F.expr(f"coalesce({round_ratio_sql(f'{churned} * 100', 'count(1)', 2)}, 0.0) AS churn_rate"),
        round_ratio("sum(tenure)", "count(tenure)", 1).alias("average_tenure"),
        mean_money("MonthlyCharges").alias("average_monthly_charges"),
        sum_money("TotalCharges").alias("total_revenue"),
        # display figure: millions, 1 dp
        F.expr(f"coalesce({round_ratio_sql(revenue, '1000000', 1)}, 0.0)"
               " AS total_revenue_millions"),
    )


def overview(subs: DataFrame, customer_type: str | None = None, region: str | None = None,
             date_start: str | None = None, date_end: str | None = None) -> DataFrame:
    return overview_summary(filter_subscribers(subs, customer_type, region, date_start, date_end))


def value_distributions(df: DataFrame, columns: Sequence[str] = DISTRIBUTION_COLUMNS) -> DataFrame:
    """(dimension, key, customers, rank) value counts of several columns in one scan.

    NULL keys are dropped; rank orders by count desc, then key.  Meant for
    categorical columns: the rank window sorts each dimension's distinct values in
    one task, which is small for categories but not for ids.
    """
    cols = list(columns)
    grouped = (df.groupingSets([[c] for c in cols], *cols)
               .agg(F.expr("count(1) AS customers"),
                    *[F.expr(f"grouping(`{c}`) AS _g{i}") for i, c in enumerate(cols)]))
    dimension = " ".join(f"WHEN _g{i} = 0 THEN {quote(c)}" for i, c in enumerate(cols))
    key = " ".join(f"WHEN _g{i} = 0 THEN `{c}`" for i, c in enumerate(cols))
    rows = grouped.selectExpr(f"CASE {dimension} END AS dimension", f"CASE {key} END AS key",
                              "customers").where("key IS NOT NULL")
    return rows.selectExpr(
        "dimension", "key", "customers",
        "row_number() OVER (PARTITION BY dimension ORDER BY customers DESC, key) AS rank")


def contract_counts(df: DataFrame) -> DataFrame:
    """Contract value counts: contract, customers, rank."""
    return (value_distributions(df, ["Contract"])
            .select(F.col("key").alias("contract"), "customers", "rank"))
