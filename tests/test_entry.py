"""Every query runs over the smallest tables and, where it has SQL, gives the same rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, rows

CORE = [q for m in entry._modules() if "llm" not in m.__name__ for q in m.QUERIES]


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CORE)
def test_query(spark, small, name):
    got = entry.queries()[name](spark, small).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = connect(small).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
