"""Every registered query against its SQL, on the whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import connect, duckdb_result, spark_result

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(medium):
    return connect(medium)


def test_every_query_has_sql():
    """But for some of the llm subpackage, which has tests of its own."""
    own = set(entry.llm.queries()) if entry.llm else set()
    assert set(QUERIES) - own <= set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, medium, name):
    got = spark_result(QUERIES[name](spark, medium))
    want = duckdb_result(con, ORACLES[name])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) > 0
    assert got[1] == want[1]


def test_entry(spark):
    assert entry.entry(spark).count() == 18
