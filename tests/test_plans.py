import pytest
from compare import same

from strata import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], "/root/testdata/sf0.001")
