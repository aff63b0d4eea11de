"""Every named query against its SQL twin on the smallest test data."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import LLM_QUERIES, entry, oracle_sql, queries  # noqa: E402
from check_queries import compare, open_duck  # noqa: E402

ROOT = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return open_duck(ROOT)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    problem, _, _, _ = compare(QUERIES[name](spark, ROOT), duck, SQL.get(name))
    assert problem is None, problem


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_query_has_sql():
    """Only training-data queries may go without; their own tests compare these with brute force."""
    assert set(QUERIES) - set(SQL) <= set(LLM_QUERIES)


def test_sql_is_plain():
    assert set(SQL) <= set(QUERIES)
    assert not [n for n, text in SQL.items() if any(mark in text for mark in ("msum(", "mavg(", "psum(", "AS_OF", "NOON"))]
