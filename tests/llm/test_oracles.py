import pytest
from helpers import DATA, rows_of, sql_rows

from attestra.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, f"{DATA}/sf0.001")
    names, expected = sql_rows(queries.ORACLES[name], f"{DATA}/sf0.001")
    assert sorted(df.columns) == names
    assert rows_of(df) == expected
