"""Every query with SQL gives what DuckDB gives, with the same types."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "tinyint": "TINYINT"}
MESH = [n for n in entry.oracle_sql() if not n.startswith("op")]


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", MESH)
def test_query(spark, db, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir)
    cur = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert {c: TYPES[t] for c, t in got.dtypes} == {d[0]: str(d[1]) for d in cur.description}
    order = sorted(names)
    key = lambda row: tuple(map(repr, row))
    expected = sorted((tuple(r[names.index(c)] for c in order) for r in cur.fetchall()), key=key)
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=key) == expected


def test_entry(spark):
    assert entry.entry(spark).count() == 6
