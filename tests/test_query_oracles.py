import pytest
from oracle import SMALL, rows_of, rows_of_sql

from plumbline.plans import catalogue


@pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    pytest.importorskip("duckdb")
    assert rows_of(catalogue.QUERIES[name](spark, str(SMALL))) == rows_of_sql(catalogue.ORACLES[name])


@pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, str(SMALL)).count() > 0
