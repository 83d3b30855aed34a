"""Driver contract, and every registered query against its DuckDB oracle at sf0.001."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as E
from churnlens.plans.catalog import QUERIES
from helpers import SF_SMALL

TABLES = ["region", "nation", "customer", "orders", "events"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 6
    assert df.columns == ["ordinal", "name", "count", "percentage", "color", "characteristics",
                          "actions"]


def test_every_query_has_oracle():
    assert set(QUERIES) <= set(E.queries())
    assert set(QUERIES) == set(E.oracle_sql()) & set(QUERIES)
    assert len(QUERIES) >= 38


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _canon(rows):
    return sorted((tuple(x for x in r) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="test data not present")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    got = [tuple(r[c] for c in cols) for r in sdf.collect()]
    rel = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    want = [tuple(r[i] for i in idx) for r in rel.fetchall()]
    assert _canon(got) == _canon(want)
