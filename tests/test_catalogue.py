"""Every registered query with SQL gives DuckDB's rows."""

import glob
import os

import duckdb
import pytest

from larkspur.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(DATA + "/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_duckdb(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    found = got.collect()
    if name in catalogue.SQL:
        want = duck.sql(catalogue.SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got.columns, found) == plain(want.columns, want.fetchall())
