"""Churn reasons: shares of contract types and internet services among churned subscribers.

One scan of the churned rows computes both value counts (GROUPING SETS); shares
divide by the non-null total of each category; internet service "No" is removed
only after the shares are computed; the result is the top ``k`` by rounded share.
Windows run on the aggregated rows only (a handful per category).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import round_ratio_sql
from ..functions.sql import quote

# Reason prefixes and category names.
CONTRACT_PREFIX = "Contrat "
SERVICE_PREFIX = "Internet "
CONTRACT_CATEGORY = "Contract"
SERVICE_CATEGORY = "Service"
EXCLUDED_SERVICE = "No"


def reason_shares(subs: DataFrame) -> DataFrame:
    """(category, value, customers, percentage) for every reason candidate, before top-k."""
    churned = subs.where("Churn = 1").select("Contract", "InternetService")
    counts = (churned.groupingSets([["Contract"], ["InternetService"]], "Contract", "InternetService")
              .agg(F.expr("count(1) AS customers"), F.expr("grouping(Contract) AS _g")))
    rows = counts.selectExpr(
        f"CASE WHEN _g = 0 THEN {quote(CONTRACT_CATEGORY)} ELSE {quote(SERVICE_CATEGORY)} END AS category",
        "CASE WHEN _g = 0 THEN Contract ELSE InternetService END AS value",
        "customers").where("value IS NOT NULL")
    # per-category totals over the aggregated rows (a handful per category)
    return rows.selectExpr(
        "category", "value", "customers",
        f"{round_ratio_sql('customers * 100', 'sum(customers) OVER (PARTITION BY category)', 1)}"
        " AS percentage")


def churn_reasons(subs: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` reasons: rank, reason, category, percentage (1 dp), customers.

    Order: rounded percentage desc, then Contract before Service, count desc, name.
    """
    kept = reason_shares(subs).where(
        f"NOT (category = {quote(SERVICE_CATEGORY)} AND value = {quote(EXCLUDED_SERVICE)})")
    named = kept.selectExpr(
        f"concat(CASE WHEN category = {quote(CONTRACT_CATEGORY)} THEN {quote(CONTRACT_PREFIX)}"
        f" ELSE {quote(SERVICE_PREFIX)} END, value) AS reason",
        "category", "percentage", "customers")
    order = (f"percentage DESC, CASE WHEN category = {quote(CONTRACT_CATEGORY)} THEN 0 ELSE 1 END,"
             " customers DESC, reason")
    top = named.orderBy(F.col("percentage").desc(),
                        F.expr(f"CASE WHEN category = {quote(CONTRACT_CATEGORY)} THEN 0 ELSE 1 END"),
                        F.col("customers").desc(), F.col("reason")).limit(k)
    # the window sees at most k rows
    return top.selectExpr(f"row_number() OVER (ORDER BY {order}) AS rank",
                          "reason", "category", "percentage", "customers")
