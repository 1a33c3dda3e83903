"""The queries that have SQL against DuckDB, at the smallest scale."""

import pytest

from reelmill.llm import queries

from ..oracle import assert_same

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", SQL)
def test_same_as_sql(spark, name):
    assert_same(spark, queries.queries()[name], SQL[name], "/root/testdata/sf0.001")
