import pytest

import __spark_entry__ as contract
from tests.compare import assert_same, connect
from wattline.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    actual = contract.queries()[name](spark, SF_DIR).toPandas()
    expected = connect(SF_DIR).sql(contract.oracle_sql()[name]).df()
    assert len(expected) > 0
    assert_same(actual, expected)


def test_every_query_has_sql():
    assert contract.oracle_sql().keys() >= QUERIES.keys()
    assert contract.queries().keys() >= contract.oracle_sql().keys()


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns[:3] == ["identifier", "startTimestamp", "endTimestamp"]
    assert rows.count() > 0
