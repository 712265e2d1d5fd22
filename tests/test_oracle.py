"""Every query that has SQL, against DuckDB at the smallest scale."""

from __future__ import annotations

import oracle
import pytest

from millrace import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_duckdb(spark, sf, con, name):
    assert oracle.difference(QUERIES[name](spark, sf), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_rows_only(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()
