"""Monthly trends computed from orders, and month-on-month KPI changes.

Per calendar month: new subscribers (first order in the month), churned
subscribers (last order in the month, for subscribers churned at the
snapshot), revenue (order total, exact to the cent) and churn rate = churned /
(subscribers acquired up to and including the month - subscribers churned
before it).

Plan: two partial aggregates over ``orders`` (per customer, per month); the
per-customer rows become at most two (month, new, churned) events each and are
aggregated per month again, so only month-level rows (one per month of
history, independent of data volume) reach the running-sum windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import MONEY, money_sql, round_ratio_sql
from ..sources.fixture import CHURN_GAP_DAYS, customer_activity
from ..sources.snapshots import SnapshotStore, named_sources


def _month(col: str) -> str:
    return f"trunc(CAST({col} AS DATE), 'MM')"


def month_revenue(orders: DataFrame) -> DataFrame:
    """(month, amount): the revenue of each month with orders, as a decimal."""
    return (orders.groupBy(F.expr(f"{_month('o_orderdate')} AS month"))
            .agg(F.expr(f"sum({money_sql('o_totalprice')}) AS amount")))


def _monthly(revenue: DataFrame, activity: DataFrame, churn_gap_days: int) -> DataFrame:
    """:func:`monthly_trends` with ``amount``, the revenue as a decimal."""
    zero, none = "CAST(0 AS BIGINT)", f"CAST(0 AS {MONEY})"
    revenue = revenue.selectExpr("month", "amount", f"{zero} AS new", f"{zero} AS churned")
    # the snapshot (latest order) is the latest of the customers' last orders
    seen = activity.where("first_order IS NOT NULL").select("first_order", "last_order")
    stamped = seen.withColumn("_snap", seen.select(F.max("last_order")).scalar())
    events = stamped.selectExpr(
        "inline(array_compact(array("
        f"named_struct('month', {_month('first_order')}, 'new', 1, 'churned', 0), "
        f"CASE WHEN last_order < _snap - INTERVAL {int(churn_gap_days)} DAYS "
        f"THEN named_struct('month', {_month('last_order')}, 'new', 0, 'churned', 1) END)))")
    per_month = (events.groupBy("month").agg(F.expr("sum(new) AS new"), F.expr("sum(churned) AS churned"))
                 .selectExpr("month", f"{none} AS amount", "new", "churned"))
    monthly = (revenue.unionByName(per_month).groupBy("month")
               .agg(F.expr("sum(amount) AS amount"), F.expr("sum(new) AS new"), F.expr("sum(churned) AS churned")))
    # a row and its gap: months without orders up to the next one are rows of zeros
    following = monthly.withColumn("next", F.expr("lead(month) OVER (ORDER BY month)"))
    monthly = following.selectExpr(
        "amount", "new", "churned", "month AS start",
        "explode(sequence(month, coalesce(add_months(next, -1), month), INTERVAL 1 MONTH)) AS month").selectExpr(
        "month", *[f"CASE WHEN month = start THEN {c} ELSE 0 END AS {c}" for c in ("amount", "new", "churned")])
    # running sums over month rows only (one per month of history)
    return monthly.selectExpr(
        "month", "CAST(new AS BIGINT) AS new_customers", "CAST(churned AS BIGINT) AS churned_customers",
        "CAST(sum(new) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        " - coalesce(sum(churned) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        " AS BIGINT) AS base_customers", "amount",
    ).selectExpr(
        "month", "new_customers", "churned_customers", "base_customers",
        f"{round_ratio_sql('amount', '1', 2)} AS revenue",
        f"{round_ratio_sql('churned_customers * 100', 'base_customers', 2)} AS churn_rate",
        "CAST(round(amount, 2) AS DECIMAL(24,2)) AS amount")


def monthly_trends(orders: DataFrame, activity: DataFrame | None = None,
                   churn_gap_days: int = CHURN_GAP_DAYS) -> DataFrame:
    """month, new_customers, churned_customers, base_customers, revenue, churn_rate (2 dp), for every
    calendar month from the first order to the last; months without orders have zeros.

    ``activity``: per-customer ``first_order``/``last_order`` already at hand (for
    example the stored subscriber table); computed from ``orders`` when omitted.
    """
    activity = customer_activity(orders) if activity is None else activity
    return _monthly(month_revenue(orders), activity, churn_gap_days).drop("amount")


def monthly_deltas(orders: DataFrame, activity: DataFrame | None = None,
                   churn_gap_days: int = CHURN_GAP_DAYS) -> DataFrame:
    """Month-on-month changes: revenue % change (1 dp; NULL after a month without revenue),
    new-customer difference, churn-rate difference in points (2 dp); NULL in the first month.
    Revenue stays a decimal until the ratio is rounded."""
    activity = customer_activity(orders) if activity is None else activity
    return _deltas(_monthly(month_revenue(orders), activity, churn_gap_days))


def _deltas(monthly: DataFrame) -> DataFrame:
    rate = "CAST(round(churn_rate * 100) AS BIGINT)"
    lagged = monthly.selectExpr(
        "month", "revenue", "new_customers", "churn_rate", "amount",
        "lag(amount) OVER (ORDER BY month) AS prev_amount",
        "lag(new_customers) OVER (ORDER BY month) AS prev_new",
        f"{rate} AS rate", f"lag({rate}) OVER (ORDER BY month) AS prev_rate")
    # both in cents, so that the divisor is integral; the factor 100 makes a percentage
    change = round_ratio_sql("CAST((amount - prev_amount) * 100 AS DECIMAL(24,0)) * 100",
                             "CAST(prev_amount * 100 AS DECIMAL(24,0))", 1)
    return lagged.selectExpr(
        "month", "revenue", f"{change} AS revenue_change_pct",
        "new_customers", "new_customers - prev_new AS new_customers_delta", "churn_rate",
        "CAST(rate - prev_rate AS DOUBLE) / 100 AS churn_rate_delta")


class TrendState:
    """What the trends need of all orders so far, kept in a snapshot store below ``root``: per
    customer the number, first and last of the orders, and per month the revenue.

    :meth:`update` merges the state of new orders into it, so that orders are read once and
    history is not scanned again; the cost follows the new orders and the customers.  Each update
    is a named batch, published with the state that holds it: a batch that is given again, for
    example after a failure, changes nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.store = SnapshotStore(spark, root)

    def batches(self) -> set[str]:
        """The names of the batches in the state."""
        return {r.source for r in self.store.sources().collect()}

    def update(self, orders: DataFrame, batch: str) -> bool:
        """Merge new ``orders`` (a late order of an earlier month too); False if the batch was
        known."""
        known = self.batches()
        if batch in known:
            return False
        activity, revenue = customer_activity(orders), month_revenue(orders)
        if self.store.newest():
            activity = self.store.read("activity").unionByName(activity).groupBy("o_custkey").agg(
                F.sum("n_orders").alias("n_orders"), F.min("first_order").alias("first_order"),
                F.max("last_order").alias("last_order"))
            revenue = self.store.read("revenue").unionByName(revenue).groupBy("month").agg(
                F.expr("CAST(sum(amount) AS DECIMAL(38,10)) AS amount"))
        self.store.write({"activity": activity, "revenue": revenue},
                         named_sources(self.store.spark, *sorted(known | {batch})))
        return True

    def monthly_trends(self, churn_gap_days: int = CHURN_GAP_DAYS) -> DataFrame:
        """:func:`monthly_trends` of all orders in the state."""
        version = self.store.newest()
        return _monthly(self.store.read("revenue", version), self.store.read("activity", version), churn_gap_days).drop("amount")

    def monthly_deltas(self, churn_gap_days: int = CHURN_GAP_DAYS) -> DataFrame:
        """:func:`monthly_deltas` of all orders in the state."""
        version = self.store.newest()
        return _deltas(_monthly(self.store.read("revenue", version), self.store.read("activity", version), churn_gap_days))
