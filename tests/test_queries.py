"""Every registered query against its SQL on the smallest supplied tables."""

import os

import pytest

import __spark_entry__ as entry_points
from catalog import QUERIES
from tools.compare import compare, connect

SF = "/root/testdata/sf0.001"
ORACLES = entry_points.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables are absent")


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    verdict = compare(spark, tables, name, entry_points.queries()[name], ORACLES.get(name), SF)
    assert verdict.startswith("ok") and "but" not in verdict, verdict


def test_compare_notices_a_difference(spark, tables):
    ours = entry_points.queries()["p17_failed_rows"]
    wrong = ORACLES["p17_failed_rows"].replace("'failed'", "'success'", 1)
    assert compare(spark, tables, "x", ours, wrong + " LIMIT 3", SF).startswith("DIFFERENT")


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1
