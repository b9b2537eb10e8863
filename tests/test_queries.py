"""Every registered query against its SQL, on the smallest test tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import differences, tables
from checks.oracle import ORACLES
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return tables(sf_dir)


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.items() <= entry.queries().items()
    assert ORACLES.items() <= entry.oracle_sql().items()


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows[0]["make"] == "Brand#1"
    assert (rows[0]["count"], rows[0]["avg"]) == (98, 54_480)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_sql(spark, connection, sf_dir, name):
    found = differences(spark, connection, sf_dir, name)
    assert not found, found[0]
