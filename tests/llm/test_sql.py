"""Queries with SQL against DuckDB over whole tables."""

import duckdb
import pytest

from docloom.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name, size):
    folder = f"/root/testdata/{size}"
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    rel = c.sql(SQL[name])
    df = queries.queries()[name](spark, folder)
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    want = sorted(tuple(r[rel.columns.index(x)] for x in columns) for r in rel.fetchall())
    assert sorted(tuple(r[x] for x in columns) for r in df.collect()) == want
