"""Every named query against its SQL twin on the smallest test tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from compare import connect, difference
from tidemark.plans.oracle import oracle_sql as own_sql
from tidemark.plans.registry import QUERIES

pytestmark = pytest.mark.skipif(not Path(SMOKE_DIR).exists(), reason="test tables are not there")

SQL = own_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMOKE_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_points_hold_all_queries():
    assert QUERIES.items() <= queries().items() and SQL.items() <= oracle_sql().items() and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert difference(spark, con, SMOKE_DIR, QUERIES[name], SQL[name]) is None


def test_entry(spark):
    assert entry(spark).columns[:2] == ["WBID", "WATERBODY_NAME"] and entry(spark).count() > 0
