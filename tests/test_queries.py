import pytest

from tests.oracle import by_spark, by_sql
from termloom.plans import catalogue, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, name):
    got = by_spark(registry.QUERIES[name](spark, SF))
    spark.catalog.clearCache()
    if name in registry.ORACLE_SQL:
        assert got == by_sql(registry.ORACLE_SQL[name], SF)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 50
    assert set(e.oracle_sql()) <= set(e.queries())
