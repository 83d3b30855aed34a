"""Schemas of the subscriber tables and of scoring requests."""

from __future__ import annotations

from pyspark.sql.types import (DoubleType, IntegerType, StringType, StructField,
                               StructType)

# Column order of the subscriber table (one row per subscriber).
SUBSCRIBER_COLUMNS = [
    "customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure",
    "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity",
    "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
    "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
    "MonthlyCharges", "TotalCharges", "Churn",
]

_INT_COLUMNS = {"SeniorCitizen", "tenure"}
_DOUBLE_COLUMNS = {"MonthlyCharges"}


def _raw_type(name: str):
    if name in _INT_COLUMNS:
        return IntegerType()
    if name in _DOUBLE_COLUMNS:
        return DoubleType()
    return StringType()


# As delivered: TotalCharges is text (blank for new subscribers), Churn is Yes/No.
RAW_SCHEMA = StructType([StructField(c, _raw_type(c), True) for c in SUBSCRIBER_COLUMNS])

# After cleaning: TotalCharges DOUBLE, Churn INT 1/0.
CLEAN_SCHEMA = StructType([
    StructField(c, DoubleType() if c == "TotalCharges" else IntegerType() if c == "Churn"
                else _raw_type(c), True)
    for c in SUBSCRIBER_COLUMNS
])

# Warehouse copy: the clean table without the subscriber id.
WAREHOUSE_COLUMNS = SUBSCRIBER_COLUMNS[1:]

# One scoring request per row, keyed by customerID.
REQUEST_SCHEMA = StructType([
    StructField("customerID", StringType(), True),
    StructField("tenure", IntegerType(), True),
    StructField("voice_usage", DoubleType(), True),
    StructField("data_usage", DoubleType(), True),
    StructField("complaints", IntegerType(), True),
    StructField("contract_type", StringType(), True),
    StructField("monthly_charges", DoubleType(), True),
    StructField("internet_service", StringType(), True),
    StructField("online_security", StringType(), True),
    StructField("tech_support", StringType(), True),
    StructField("streaming_tv", StringType(), True),
])

# The text of a row that could not be read as its schema says; NULL for all others.
CORRUPT = "_corrupt_record"
