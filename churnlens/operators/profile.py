"""Table profiles: preview, column structure (type, non-null count), null counts.

Each profile is ONE aggregate over the table (one count per column), turned
into one row per column with ``stack``; types come from the DataFrame schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def head(df: DataFrame, n: int = 5, order_by: str = "customerID") -> DataFrame:
    """First ``n`` rows in key order (files have no inherent row order)."""
    return df.orderBy(order_by).limit(n)


def _per_column(df: DataFrame, agg, value_name: str) -> DataFrame:
    """One aggregate pass computing ``agg(column)`` for every column, then one row per
    column: position, column_name, data_type, <value_name>, total_rows."""
    fields = df.schema.fields
    aggs = [agg(F.col(f"`{f.name}`")).alias(f"_v{i}") for i, f in enumerate(fields, start=1)]
    wide = df.agg(F.count(F.lit(1)).alias("_total"), *aggs)
    parts = []
    for i, f in enumerate(fields, start=1):
        name = f.name.replace("'", "\\'")
        parts.append(f"{i}, '{name}', '{f.dataType.simpleString()}', `_v{i}`")
    return (wide.selectExpr(
        f"stack({len(fields)}, {', '.join(parts)}) AS (position, column_name, data_type, {value_name})",
        "_total AS total_rows")
        .withColumn("position", F.col("position").cast("int")))


def structure_profile(df: DataFrame) -> DataFrame:
    """position, column_name, data_type, non_null_count, total_rows."""
    return _per_column(df, F.count, "non_null_count")


def null_profile(df: DataFrame) -> DataFrame:
    """position, column_name, data_type, null_count."""
    return _per_column(df, lambda c: F.count_if(c.isNull()), "null_count").drop("total_rows")
