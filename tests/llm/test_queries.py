"""The corpus queries that have SQL, against it at the smallest scale."""

import pytest

from check import compare, connect
from touchline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(spark, name):
    result, rows = compare(spark, connect(SF), SF, queries.QUERIES[name], queries.ORACLES[name])
    assert (result, rows > 0) == ("ok", True)
