"""Every query with SQL must give DuckDB's rows; the others must run and have rows wherever the data has what they look for."""

import duckdb
import pytest

from quire import catalog

SF = "/root/testdata/sf0.001"
NO_ROWS = {"html_alt"}  # the pages have no images


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    query, sql = catalog.QUERIES[name]
    df = query(spark, SF)
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    if sql is None:
        assert got or name in NO_ROWS
        return
    rel = duck.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    order = [rel.columns.index(c) for c in sorted(rel.columns)]
    want = [tuple(r[i] for i in order) for r in rel.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
