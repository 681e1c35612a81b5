import compare
import pytest

import __spark_entry__ as entry
from paperloom.plans.oracle import ORACLE
from paperloom.plans.suite import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return compare.duck(sf)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_of_the_suite_has_sql():
    assert set(ORACLE) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_matches_sql(spark, sf, con, name):
    got = entry.queries()[name](spark, sf).toPandas()
    assert compare.differences(got, con.sql(entry.oracle_sql()[name]).df()) is None
