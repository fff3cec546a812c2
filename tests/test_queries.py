"""Every registered query on the smallest tables, against its SQL where it has one."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


def test_every_check_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, data, name):
    if name in SQL:
        ok, info = compare(spark, con, name, QUERIES[name], SQL[name], data)
        assert ok, info
    else:
        rows = QUERIES[name](spark, data)
        rows.write.format("noop").mode("overwrite").save()
        assert rows.columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
