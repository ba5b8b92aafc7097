"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def normal(rows):
    def cell(value):
        if isinstance(value, float):
            return None if math.isnan(value) else round(value, 9)
        return value

    return sorted((tuple(cell(v) for v in row) for row in rows), key=lambda r: [(v is not None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, database, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    assert rows
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    expected = database.sql(f"SELECT {', '.join(columns)} FROM ({sql})")
    assert sorted(d[0] for d in database.sql(sql).description) == columns
    assert normal(rows) == normal(expected.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
