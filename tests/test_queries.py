import pytest

import __spark_entry__ as entry
from riskgrid.plans import registry

from compare import rows, tables


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sf, name):
    got = rows(entry.queries()[name](spark, sf).toPandas())
    assert got == rows(tables(sf).sql(entry.oracle_sql()[name]).df())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["tx_id", "fraud_count", "fraud_score", "approved"] and out.count() == 20


def test_every_query_is_registered():
    assert set(registry.ORACLES) == set(registry.QUERIES) <= set(entry.queries())
