import pytest

from tests.oracle import assert_same, connect
from undula.plans import catalogue, numeric  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert_same(catalogue.QUERIES[name](spark, SF), connect(SF), catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_numeric_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 30
    assert set(catalogue.QUERIES) <= set(e.queries())
