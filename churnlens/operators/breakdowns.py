"""Churn and revenue broken down by band or contract (one partial+final aggregate each)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bands import (CHARGE_EDGES, CHARGE_LABELS, TENURE_EDGES, TENURE_LABELS,
                              band_label_sql, band_ordinal_sql)
from ..functions.rounding import round_ratio, sum_money


def churn_by_tenure(subs: DataFrame) -> DataFrame:
    """Per tenure band: churn rate (mean of Churn, %, 2 dp) and subscriber count.

    Bands are right-closed; tenure 0, tenure above 72 and NULL are left out;
    empty bands do not appear.
    """
    banded = subs.selectExpr(f"{band_ordinal_sql('tenure', TENURE_EDGES)} AS ordinal", "Churn",
                             "customerID").where("ordinal IS NOT NULL")
    out = banded.groupBy("ordinal").agg(
        round_ratio("sum(Churn) * 100", "count(Churn)", 2).alias("churn_rate"),
        F.expr("count(customerID) AS customers"))
    return out.selectExpr(f"{band_label_sql('ordinal', TENURE_LABELS)} AS tenure_band", "ordinal",
                          "churn_rate", "customers")


def revenue_by_band(subs: DataFrame) -> DataFrame:
    """Per monthly-charge band: revenue (sum of TotalCharges, exact to the cent) and count."""
    banded = subs.selectExpr(f"{band_ordinal_sql('MonthlyCharges', CHARGE_EDGES)} AS ordinal",
                             "TotalCharges", "customerID").where("ordinal IS NOT NULL")
    out = banded.groupBy("ordinal").agg(
        sum_money("TotalCharges").alias("revenue"), F.expr("count(customerID) AS customers"))
    return out.selectExpr(f"{band_label_sql('ordinal', CHARGE_LABELS)} AS segment", "ordinal",
                          "revenue", "customers")


def retention_by_offer(subs: DataFrame) -> DataFrame:
    """Per contract: retention rate ((1 - mean Churn) * 100, 2 dp) and subscriber count."""
    return (subs.where("Contract IS NOT NULL")
            .groupBy(F.col("Contract").alias("offer"))
            .agg(round_ratio("(count(Churn) - sum(Churn)) * 100", "count(Churn)", 2)
                 .alias("retention_rate"),
                 F.count("customerID").alias("customers")))
