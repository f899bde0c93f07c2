"""The subpackage's SQL twins on the smallest test tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from compare import connect, difference
from tidemark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not there")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    assert difference(spark, connect(SF), SF, QUERIES[name], ORACLE_SQL[name]) is None
