"""Every registered query with SQL must return the rows DuckDB returns on the same tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    if name in ORACLES:
        assert compare(got, duck.execute(ORACLES[name]).df()) == ""
    else:
        assert len(got) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
