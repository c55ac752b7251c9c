"""Every query against its SQL on the smallest tables; those without SQL must give rows or none, with stable columns."""

import pytest

from checks import same_rows
from stackroom.plans.registry import ORACLES, QUERIES

import __spark_entry__  # noqa: F401  registers the queries


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, small, name):
    same_rows(duck, QUERIES[name](spark, small), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, small, name):
    assert QUERIES[name](spark, small).toArrow().num_columns > 0
