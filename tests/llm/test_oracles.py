"""The operators' queries against their SQL, over the whole smallest tables."""

import pytest

from checks import same_rows
from stackroom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, small, name):
    same_rows(duck, QUERIES[name](spark, small), ORACLES[name])
