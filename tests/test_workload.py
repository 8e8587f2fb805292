"""Registered queries against their SQL counterparts in another engine."""

import duckdb
import pytest

import __spark_entry__ as contract
from tests.conftest import TESTDATA
from workload.oracles import ORACLES
from workload.queries import QUERIES

@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in ("orders", "documents", "pages"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TESTDATA}/{name}.parquet'")
    return connection


def test_every_query_has_a_counterpart(database):
    assert QUERIES.keys() == ORACLES.keys()
    assert contract.queries().keys() >= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, database, name):
    def rows(names, values):
        order = sorted(range(len(names)), key=lambda i: names[i])
        picked = [tuple(row[i] for i in order) for row in values]
        return sorted(names), sorted(picked, key=repr)

    frame = QUERIES[name](spark, TESTDATA)
    cursor = database.execute(ORACLES[name])
    expected = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert rows(frame.columns, frame.collect()) == expected
    assert expected[1], "a query without rows proves nothing"


def test_entry(spark):
    assert contract.entry(spark).first().total_count > 0
