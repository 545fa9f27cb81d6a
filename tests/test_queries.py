import pytest

from ragframe.plans.registry import catalogue
from tests.compare import duck_rows, spark_rows

QUERIES, ORACLES = catalogue()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, name):
    assert spark_rows(QUERIES[name](spark, sf)) == duck_rows(sf, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
