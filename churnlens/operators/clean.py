"""Cleaning: numeric coercion, null fills, Yes/No mapping, column drops.

Two fill rules exist for unparseable TotalCharges: ``"zero"`` (the default) and
``"median"`` (the exact median of the parseable values, evaluated once as a
scalar subquery, so no join or driver round trip is involved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import MONEY, MONEY_LIMIT
from ..schema import WAREHOUSE_COLUMNS


def money_range(col: Column) -> Column:
    """NaN, the infinities and what no money column can hold (10^18 and beyond) -> NULL: not a
    number one can add up (skipped by aggregates, false in comparisons)."""
    return F.when(F.abs(col) < F.lit(MONEY_LIMIT), col)


def coerce_double(col: Column) -> Column:
    """Text to DOUBLE; unparseable values (blank, junk), NaN, the infinities and numbers beyond the
    money range to NULL; never raises."""
    return money_range(col.try_cast("double"))


def yes_no_flag(col: Column) -> Column:
    """'Yes' -> 1, 'No' -> 0, anything else (including NULL) -> NULL."""
    return F.when(col == "Yes", 1).when(col == "No", 0).cast("int")


def exact_median(df: DataFrame, col: str, accuracy: int = 100_000) -> DataFrame:
    """One-row DataFrame ``median``: the interpolated median of a numeric column, exactly.

    Two passes.  A quantile sketch gives two values between which the middle ranks lie: its rank
    error is at most n / ``accuracy``, and the values are taken at twice that distance from the
    middle.  Then the distinct values between the two are counted, all values below and above them
    as one group each, and running totals of these counts find the middle.  So one task orders at
    most some 6 / ``accuracy`` of the rows, however the values lie, and outliers cost nothing.  Should
    the sketch ever break its promise, the query fails rather than give another value.

    The mean of a middle pair is exact for money; NULL and NaN are skipped; no rows -> NULL.
    """
    values = df.select(F.col(col).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    off = 2.0 / accuracy
    bounds = values.agg(F.percentile_approx("v", [max(0.5 - off, 0.0), min(0.5 + off, 1.0)], accuracy).alias("b")).scalar()
    side = F.when(F.col("v") < F.col("b")[0], -1).when(F.col("v") > F.col("b")[1], 1).otherwise(0)
    counted = (values.withColumn("b", bounds).select(side.alias("side"), "v")
               .groupBy("side", F.when(F.col("side") == 0, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c")))
    order = Window.orderBy("side", "v")  # over the few values between the bounds, and two groups
    placed = counted.select("side", "v", "c", (F.sum("c").over(order) - F.col("c")).alias("start"),
                            F.sum("c").over(Window.partitionBy(F.lit(0))).alias("n"))
    # 0-based ranks of the middle pair
    hit = [F.expr(f"start <= {k} AND {k} < start + c") for k in ("(n - 1) div 2", "n div 2")]
    middle = [F.max(F.when(h, F.col("v"))) for h in hit]
    money = [m.try_cast(MONEY) for m in middle]  # NULL beyond the money range
    missed = F.coalesce(F.max((hit[0] | hit[1]) & (F.col("side") != 0)), F.lit(False))
    return placed.agg(F.when(missed, F.raise_error(F.lit("median outside the sketched bounds")).cast("double"))
                      .otherwise(F.coalesce(((money[0] + money[1]) / 2).cast("double"), (middle[0] + middle[1]) / 2))
                      .alias("median"))


def clean_subscribers(raw: DataFrame, fill: str = "zero") -> DataFrame:
    """Raw table (TotalCharges text, Churn Yes/No) to the clean table (DOUBLE, INT).

    ``fill``: ``"zero"`` replaces unparseable TotalCharges with 0.0, ``"median"``
    with the median of the parseable values.  Extra columns pass through.
    """
    total = coerce_double(F.col("TotalCharges"))
    if fill == "zero":
        filler = F.lit(0.0)
    elif fill == "median":
        parsed = raw.select(total.alias("TotalCharges"))
        filler = exact_median(parsed, "TotalCharges").scalar()
    else:
        raise ValueError(f"unknown fill rule {fill!r}")
    return raw.withColumns({
        "MonthlyCharges": money_range(F.col("MonthlyCharges").cast("double")),
        "TotalCharges": F.coalesce(total, filler),
        "Churn": yes_no_flag(F.col("Churn")),
    })


def warehouse_rows(raw: DataFrame) -> DataFrame:
    """Batch-pipeline cleaning: drop the id, median fill, map Churn (20 columns)."""
    return clean_subscribers(raw, fill="median").select(*WAREHOUSE_COLUMNS)
