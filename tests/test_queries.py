"""Every query with SQL agrees with it; the others give rows with a stable schema."""

import pytest
from oracle import compare

from tessera import registry as catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    assert compare(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).take(1)
