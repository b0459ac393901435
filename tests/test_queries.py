"""Every registered query of the library against its SQL twin; the others for rows."""

import pytest
from sqltwin import same

from veilwork import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    result = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        same(result, SQL[name], sf)
    else:
        assert len(result)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
