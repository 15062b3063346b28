"""Every named query against its SQL on an independent engine."""

import pytest

from payguard.plans import registry

from .conftest import SF


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, same, name):
    same(registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).df())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
