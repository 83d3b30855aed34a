"""Headline figures over the clean subscriber table; each is a single aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import mean_money, round_ratio


def kpis(subs: DataFrame) -> DataFrame:
    """total, churned, churn rate (% of all rows, 2 dp), ARPU and CLV (means, 2 dp), active.

    The rate divides by every row (``count(*)``), the means skip NULLs.
    """
    total = F.count(F.lit(1))
    churned = F.coalesce(F.sum("Churn"), F.lit(0)).cast("bigint")
    return subs.agg(
        total.alias("total_customers"),
        churned.alias("churn_count"),
        round_ratio(churned * 100, total, 2).alias("churn_rate"),
        mean_money("MonthlyCharges").alias("arpu"),
        mean_money("TotalCharges").alias("clv"),
        (total - churned).alias("active_customers"),
    )


def churn_rate(subs: DataFrame) -> DataFrame:
    """Mean of Churn (NULLs skipped) in percent: unrounded and exactly rounded to 2 dp."""
    return subs.agg(
        F.expr("try_divide(CAST(sum(Churn) AS DOUBLE), CAST(count(Churn) AS DOUBLE)) * 100 AS churn_rate"),
        round_ratio("sum(Churn) * 100", "count(Churn)", 2).alias("churn_rate_2dp"),
    )
