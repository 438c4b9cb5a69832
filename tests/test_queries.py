import pytest
from compare import same_rows

from lodestone.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_those_of_sql(spark, folder, name):
    same_rows(QUERIES[name](spark, folder), SQL[name], folder)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_run(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_flagship(spark, folder):
    rows = catalog.flagship(spark, folder).collect()
    assert sorted(r["rank"] for r in rows) == [1, 2, 3, 4, 5]
