"""Names and rows that several test modules share."""

from __future__ import annotations

from churnlens.schema import CLEAN_SCHEMA, REQUEST_SCHEMA

SF_SMALL = "/root/testdata/sf0.001"

BASE_SUB = dict(customerID="C", gender="Male", SeniorCitizen=0, Partner="No", Dependents="No",
                tenure=30, PhoneService="Yes", MultipleLines="No", InternetService="DSL",
                OnlineSecurity="No", OnlineBackup="No", DeviceProtection="No", TechSupport="No",
                StreamingTV="No", StreamingMovies="No", Contract="One year", PaperlessBilling="No",
                PaymentMethod="Mailed check", MonthlyCharges=60.0, TotalCharges=1800.0, Churn=0)


def make_subs(spark, rows):
    """Clean subscriber rows from partial dicts (missing fields take BASE_SUB values)."""
    full = []
    for i, r in enumerate(rows):
        d = dict(BASE_SUB, customerID=f"C{i:04d}")
        d.update(r)
        full.append(tuple(d[f.name] for f in CLEAN_SCHEMA.fields))
    return spark.createDataFrame(full, CLEAN_SCHEMA)


BASE_REQ = dict(customerID="R", tenure=30, voice_usage=100.0, data_usage=5.0, complaints=0,
                contract_type="postpaid", monthly_charges=50.0, internet_service="DSL",
                online_security="Yes", tech_support="Yes", streaming_tv="No")


def make_requests(spark, rows):
    full = []
    for i, r in enumerate(rows):
        d = dict(BASE_REQ, customerID=f"R{i:04d}")
        d.update(r)
        full.append(tuple(d[f.name] for f in REQUEST_SCHEMA.fields))
    return spark.createDataFrame(full, REQUEST_SCHEMA)
