"""The registered queries with SQL against DuckDB, and what the entry point registers."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__
import oracle
from lathework.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_small, name):
    found = queries.QUERIES[name](spark, sf_small)
    assert oracle.differences(found, oracle.connect(sf_small), queries.ORACLES[name]) == []


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
