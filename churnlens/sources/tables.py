"""Readers for the source Parquet tables (one file or directory per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Columns each derivation needs; selecting them keeps the scan's ReadSchema narrow.
COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
    "events": ["event_id", "ts", "user_id", "event_type", "value"],
}


def table(spark: SparkSession, data_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")
    cols = columns if columns is not None else COLUMNS.get(name)
    return df.select(*cols) if cols else df


class Tables:
    """Lazy handles on the source tables of one data directory."""

    def __init__(self, spark: SparkSession, data_dir: str):
        self.spark = spark
        self.data_dir = data_dir
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:  # one file listing per table and workspace
            self._frames[name] = table(self.spark, self.data_dir, name)
        return self._frames[name]
