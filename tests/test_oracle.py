"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from docloom.plans import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(own.queries())


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 4) if isinstance(v, float) else v if v is None or isinstance(v, (bool, int, str)) else str(v)


def test_every_query_has_sql():
    assert set(own.oracle_sql()) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = own.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(own.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    assert got == sorted((tuple(plain(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
