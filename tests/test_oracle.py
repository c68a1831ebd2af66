"""Every registered query against its SQL twin on the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry_point
from checks.compare import difference, duck
from checks.oracle import oracle
from checks.spark_queries import QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")
SQL = oracle()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_twin():
    assert set(SQL) == set(QUERIES) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, SQL[name]) is None
    assert con.execute(f"SELECT count(*) FROM ({SQL[name]})").fetchone()[0] > 0  # an empty result shows nothing


def test_flagship_has_rows(spark):
    assert entry_point.entry(spark).count() > 0
