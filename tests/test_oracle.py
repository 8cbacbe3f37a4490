"""Every registered query against its oracle SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from verify import KINDS, TABLES, rows_of

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, db):
    frame = QUERIES[name](spark, sf)
    got = rows_of(frame.columns, frame.collect())
    if name not in ORACLES:
        assert got
        return
    result = db.execute(ORACLES[name])
    header = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    assert sorted(header) == sorted(frame.columns)
    for field in frame.schema.fields:
        text = field.dataType.simpleString()
        assert KINDS.get(text, text) == kinds[field.name], field.name
    assert got == rows_of(header, result.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    frame = entry.entry(spark)
    assert frame.columns[0] == "order_date"
    assert frame.count() > 0
