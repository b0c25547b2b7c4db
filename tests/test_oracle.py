"""Every query against its SQL statement on the smallest tables."""

import pytest

import __spark_entry__ as entry
from workload import check

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, name):
    assert check.difference(spark, name, FOLDER) in (None, check.EMPTY)


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
