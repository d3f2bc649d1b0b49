import pytest
from oracle import SMALL, rows_of, rows_of_sql

from plumbline.llm import queries


@pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    pytest.importorskip("duckdb")
    assert rows_of(queries.QUERIES[name](spark, str(SMALL))) == rows_of_sql(queries.ORACLES[name])
