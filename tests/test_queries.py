"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pagemill.queries import QUERIES
from tests.conftest import SF_DIR

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(rows):
    return sorted((tuple(None if v is None else str(v) for v in row) for row in rows), key=str)


def test_every_query_has_its_sql():
    assert set(QUERIES) <= set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = duck.execute(ORACLE[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == columns
    want = [tuple(row[names.index(c)] for c in columns) for row in got.fetchall()]
    assert canonical(tuple(r) for r in df.select(*columns).collect()) == canonical(want)
