import pytest

from checks import compare
from reviewmill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    want = compare.database(SF).execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert compare.rows_of(got.columns, got.collect()) == compare.rows_of(columns, want.fetchall())
