"""Every query with oracle SQL against DuckDB on the smallest tables."""

import pytest
from conftest import SF, same

from voxloom.plans import oracles, queries

SQL, QUERIES = oracles.oracle_sql(), queries.queries()


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches(name, spark, duck):
    same(QUERIES[name](spark, SF), duck.sql(SQL[name]))
