"""Every registered query against its SQL on the smallest tables, and the entry-point contract."""

from __future__ import annotations

import pytest
from oracle import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from lathework.plans import QUERIES

# an optional subpackage tests its own queries
KNOWN = {name: function for name, function in queries().items() if name in QUERIES}
SQL = {name: sql for name, sql in oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con(sf_small):
    return connect(sf_small)


def test_entry(spark):
    rows = entry(spark).collect()
    assert {r["split"] for r in rows} == {"train", "validation", "test"}


def test_oracles_belong_to_queries():
    assert set(SQL) <= set(KNOWN)
    assert set(KNOWN) - set(SQL) == {"knn_indexed"}


@pytest.mark.parametrize("name", sorted(KNOWN))
def test_query(spark, sf_small, con, name):
    df = KNOWN[name](spark, sf_small)
    if name in SQL:
        assert differences(df, con, SQL[name]) == []
    else:
        assert df.count() > 0
