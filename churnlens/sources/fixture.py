"""Subscriber tables derived from the order-entry tables.

``customer`` gives one subscriber per row; ``orders`` gives contract length
(order count), churn (no order in the last ``CHURN_GAP_DAYS`` days before the
latest order) and the signup date (first order); ``events`` gives the usage
figures of scoring requests.  Everything is integer arithmetic and CASE, so the
same rows come out of any SQL engine.

Plan shape: ``orders`` is aggregated per customer (partial aggregation before
the shuffle, so a customer holding a third of all orders costs one row per
task), then joined 1:1 to ``customer``.  Snapshot dates are scalar subqueries,
evaluated once; no cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SUBSCRIBER_COLUMNS

CHURN_GAP_DAYS = 290
# The usage figures of a request are per month: activity of the last month before the latest event.
USAGE_DAYS = 31


def _days(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} DAYS")


def customer_activity(orders: DataFrame) -> DataFrame:
    """Per customer: number of orders, first and last order time."""
    return orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.min("o_orderdate").alias("first_order"),
        F.max("o_orderdate").alias("last_order"),
    )


def _hash(mult: int) -> str:
    return f"((c_custkey * {mult} + 12345) % 10007)"


def _yes_no(mult: int, pct_yes: int) -> str:
    return f"CASE WHEN {_hash(mult)} % 100 < {pct_yes} THEN 'Yes' ELSE 'No' END"


def _addon(mult: int) -> str:
    return (f"CASE WHEN inet = 'No' THEN 'No internet service' "
            f"WHEN {_hash(mult)} % 100 < 45 THEN 'Yes' ELSE 'No' END")


# Attribute derivations as SQL expressions (one JVM call each when the plan is built).
_STAGE = [
    "c_custkey", "c_name", "c_nationkey", "n_orders", "first_order", "last_order",
    "CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'Fiber optic' "
    "WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'DSL' ELSE 'No' END AS inet",
    f"{_yes_no(7919, 90)} AS phone",
    "1800 + CAST(floor((CAST(round(c_acctbal * 100) AS BIGINT) + 100000) * 10200 / 1100000) AS BIGINT)"
    " AS monthly_cents",
    f"CAST({_hash(503)} % 73 AS INT) AS tenure",
]
_ATTRS = [
    "c_name AS customerID",
    f"CASE WHEN {_hash(101)} % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender",
    f"CAST(CASE WHEN {_hash(211)} % 100 < 16 THEN 1 ELSE 0 END AS INT) AS SeniorCitizen",
    f"{_yes_no(307, 50)} AS Partner",
    f"{_yes_no(401, 30)} AS Dependents",
    "tenure",
    "phone AS PhoneService",
    f"CASE WHEN phone = 'No' THEN 'No phone service' WHEN {_hash(601)} % 100 < 45 THEN 'Yes' ELSE 'No' END"
    " AS MultipleLines",
    "inet AS InternetService",
    f"{_addon(701)} AS OnlineSecurity",
    f"{_addon(809)} AS OnlineBackup",
    f"{_addon(907)} AS DeviceProtection",
    f"{_addon(1009)} AS TechSupport",
    f"{_addon(1103)} AS StreamingTV",
    f"{_addon(1201)} AS StreamingMovies",
    "CASE WHEN coalesce(n_orders, 0) <= 10 THEN 'Month-to-month' WHEN n_orders <= 12 THEN 'One year'"
    " ELSE 'Two year' END AS Contract",
    f"{_yes_no(1301, 60)} AS PaperlessBilling",
    f"element_at(array('Electronic check', 'Mailed check', 'Bank transfer (automatic)',"
    f" 'Credit card (automatic)'), CAST({_hash(1409)} % 4 + 1 AS INT)) AS PaymentMethod",
    "CAST(monthly_cents AS DOUBLE) / 100 AS MonthlyCharges",
    "CASE WHEN tenure = 0 THEN ' ' ELSE CAST(CAST(CAST(monthly_cents * tenure AS DECIMAL(20,0)) / 100"
    " AS DECIMAL(18,2)) AS STRING) END AS TotalCharges",
]


def subscriber_base(customer: DataFrame, orders: DataFrame,
                    churn_gap_days: int = CHURN_GAP_DAYS) -> DataFrame:
    """Raw subscriber columns plus ``c_custkey``, ``c_nationkey``, ``signup_date`` and the
    first/last order times (NULL for subscribers without orders)."""
    snap = orders.select(F.max("o_orderdate")).scalar()
    activity = customer_activity(orders)
    joined = customer.join(activity, customer.c_custkey == activity.o_custkey, "left")
    staged = joined.selectExpr(*_STAGE)
    last = F.col("last_order")
    churn = F.when(last.isNull() | (last < snap - _days(churn_gap_days)), "Yes").otherwise("No")
    return staged.select(
        *[F.expr(e) for e in _ATTRS], churn.alias("Churn"),
        "c_custkey", "c_nationkey", F.expr("CAST(first_order AS DATE) AS signup_date"),
        "first_order", "last_order")


def subscriber_dim(base: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """(customerID, region, signup_date).  nation/region are tiny dimension tables:
    Spark's size-checked automatic broadcast keeps the large side unshuffled."""
    return (base.join(nation, base.c_nationkey == nation.n_nationkey)
            .join(region, nation.n_regionkey == region.r_regionkey)
            .select("customerID", F.col("r_name").alias("region"), "signup_date"))


def with_region(base: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Base rows with their region name attached (same rows as the dimension join)."""
    return (base.join(nation, base.c_nationkey == nation.n_nationkey)
            .join(region, nation.n_regionkey == region.r_regionkey)
            .drop("n_nationkey", "n_name", "n_regionkey", "r_regionkey")
            .withColumnRenamed("r_name", "region"))


def usage_summary(events: DataFrame, days: int = USAGE_DAYS) -> DataFrame:
    """Per user with an event: complaints (errors), voice (ten minutes a click) and data (value of
    views) of the last ``days`` days before the latest event."""
    kind = F.col("event_type")
    view_cents = F.round(F.col("value") * 100).cast("bigint")
    # the snapshot is one scalar subquery, bound once as a column
    stamped = events.withColumn("_snap", events.select(F.max("ts")).scalar())
    recent = F.col("ts") > F.col("_snap") - _days(days)
    return stamped.groupBy("user_id").agg(
        F.sum(F.when((kind == "error") & recent, 1).otherwise(0)).cast("int").alias("complaints"),
        F.sum(F.when((kind == "click") & recent, 10).otherwise(0)).cast("double").alias("voice_usage"),
        (F.floor(F.sum(F.when((kind == "view") & recent, view_cents).otherwise(0))
                 .cast("double") / 50).cast("double") / 100).alias("data_usage"),
    )


def score_requests(base: DataFrame, events: DataFrame) -> DataFrame:
    """One scoring request per subscriber with events (schema ``REQUEST_SCHEMA``).

    Seniors get a NULL charge (exercises the default), month-to-month subscribers a
    mixed-case 'Prepaid' contract type; users without clicks or views have zero usage.
    """
    usage = usage_summary(events)
    b = base.alias("b")
    joined = usage.join(b, usage.user_id == F.col("b.c_custkey"))
    return joined.select(
        F.col("b.customerID").alias("customerID"),
        F.col("b.tenure").alias("tenure"),
        "voice_usage", "data_usage", "complaints",
        F.when(F.col("b.Contract") == "Month-to-month", "Prepaid").otherwise("postpaid")
         .alias("contract_type"),
        F.when(F.col("b.SeniorCitizen") == 1, F.lit(None).cast("double"))
         .otherwise(F.col("b.MonthlyCharges")).alias("monthly_charges"),
        F.col("b.InternetService").alias("internet_service"),
        F.col("b.OnlineSecurity").alias("online_security"),
        F.col("b.TechSupport").alias("tech_support"),
        F.col("b.StreamingTV").alias("streaming_tv"),
    )
