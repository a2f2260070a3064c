import pytest

from cairnfold.llm import queries
from tests.oracle import connect, rows


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, small, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    if name not in queries.SQL:
        assert len(got) > 0
        return
    want = connect(small).execute(queries.SQL[name]).df()
    assert rows(got) == rows(want)
