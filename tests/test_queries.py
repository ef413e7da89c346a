"""Every registered query of the search engine against its SQL, on the small tables."""

import os

import duckdb
import pytest

from lectern.plans.catalog import ORACLES, QUERIES

DATA = os.environ.get("LECTERN_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Costly on a small machine, and covered by tests of their own.
APART = {"streamed_postings"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return connection


def comparable(frame):
    rows = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    return sorted((tuple(round(v, 5) if isinstance(v, float) else str(v) for v in row) for row in rows.values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - APART))
def test_query(spark, duck, name):
    made = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLES:
        expected = duck.execute(ORACLES[name]).df()
        assert sorted(made.columns) == sorted(expected.columns)
        assert comparable(made) == comparable(expected)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) >= len(QUERIES)


def test_oracles_are_sql(duck):
    import __spark_entry__

    for name, sql in __spark_entry__.oracle_sql().items():
        assert isinstance(sql, str), name
        duck.execute(f"explain {sql}")
