from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import MEDIUM, SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with columns whose names the operators use."""
    def make(rows, clash=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clash:
            for name in ("ids", "size", "score", "c", "id", "h", "_id", "_text", "component_id", "n_tokens", "range"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df
    return make


@pytest.fixture(scope="session")
def medium(spark):
    return spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet")
