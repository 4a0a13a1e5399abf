import pytest
from oracle import compare

from graphloom.llm import queries, sql


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, queries.QUERIES[name], sql.ORACLES[name])
