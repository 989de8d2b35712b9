"""Every registered query against its DuckDB oracle at sf0.01: row count,
column names and an order-free hash of all values."""

from __future__ import annotations

import pytest

from tests.conftest import SF_ORACLE, digest, rows_of

import __spark_entry__ as entry_mod
from circula.plans.catalog import ORACLE, QUERIES


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck_oracle, name):
    df = QUERIES[name](spark, SF_ORACLE)
    srows = rows_of(df)
    res = duck_oracle.execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert digest(srows, df.columns) == digest(orows, ocols)


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 10
    assert df.columns[:3] == ["RowNo", "TransactionID", "LoanID"]
