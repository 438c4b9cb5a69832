import pytest
from compare import same_rows

from lodestone.llm import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_those_of_sql(spark, folder, name):
    same_rows(QUERIES[name](spark, folder), SQL[name], folder)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_run(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert df.count() > 0 and len(df.columns) == len(set(df.columns))
