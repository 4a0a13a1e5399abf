import pytest
from oracle import compare

import __spark_entry__
from graphloom.plans import registry


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["brand", "id", "depth", "root"] and df.limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLES[name])
