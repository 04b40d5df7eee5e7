"""All registered queries on the small tables, compared with their SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import DATA
from promptgov.plans.oracles import oracles
from promptgov.plans.queries import queries

QUERIES, ORACLES = queries(), oracles()
TABLES = [f[:-8] for f in sorted(os.listdir(DATA)) if f.endswith(".parquet")]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["tenant", "allowed", "blocked", "rate_limited"]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The same tables, each as a folder of several files."""
    path = tmp_path_factory.mktemp("folders")
    for table in TABLES:
        spark.read.parquet(f"{DATA}/{table}.parquet").repartition(3).write.parquet(f"{path}/{table}.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["stream_gate", "stream_anomaly", "stream_bucket", "stream_remaining", "stream_stats",
                                  "audit_fanout"])
def test_streams_read_folders(spark, folders, name):
    """A table that is a folder of files streams as one that is a single file."""
    got, want = (QUERIES[name](spark, sf) for sf in (folders, DATA))
    data = want.collect()
    assert data and rows(got.columns, got.collect()) == rows(want.columns, data)
