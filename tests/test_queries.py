"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from verification import compare
from verification.oracles import ORACLES
from verification.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return compare.connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    _, difference = compare.compare(spark, db, SF_DIR, name)
    assert difference is None
