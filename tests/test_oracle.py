import pytest

from figmill.plans import catalog
from tests import oracle

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, con, name):
    assert oracle.rows_of(QUERIES[name](spark, data)) == oracle.rows_of_sql(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["det_id", "series", "x", "y_left", "y_right_or_value"]
    assert set(e.oracle_sql()) <= set(e.queries())
