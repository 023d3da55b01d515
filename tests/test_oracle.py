"""Every registered query with SQL returns the rows that DuckDB returns."""

import pytest

import larkspur.queries as library
from tests.compare import assert_same, connect


#: Queries without rows in the smallest tables.
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_same_rows(name, spark, sf_dir, con):
    assert assert_same(library.queries()[name](spark, sf_dir), con, library.oracle_sql()[name]) or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(library.queries().keys() - library.oracle_sql().keys()))
def test_runs(name, spark, sf_dir):
    assert library.queries()[name](spark, sf_dir).head(1)
