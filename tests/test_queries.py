"""Every registered query against its SQL twin, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import difference, tables

SF = os.environ.get("SPANLOOM_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def other_engine():
    return tables(SF)


def test_every_query_has_a_twin():
    assert set(entry.ORACLES) == set(entry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.QUERIES))
def test_query(spark, other_engine, name):
    said = difference(spark, other_engine, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert said is None, said


def test_entry(spark):
    assert entry.entry(spark).count() > 0
