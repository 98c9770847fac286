"""Every registered query against its SQL, on the small tables."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry
from feedwatch import registry
from tests.oracle import compare, connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
registry.load()
QUERIES, SQL = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert name in SQL
    assert compare(QUERIES[name](spark, SF), con, SQL[name]) is None


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns == ["rule_pos", "site", "pos", "match"]
    assert rows.count() > 0
