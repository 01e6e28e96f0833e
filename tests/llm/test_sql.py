"""The queries that SQL can express, against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from textloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = con.sql(SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    shown = lambda row: tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in row)
    assert sorted(shown(r) for r in df.select(*columns).collect()) == sorted(shown([r[i] for i in at]) for r in found.fetchall())
