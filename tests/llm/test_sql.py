"""Queries that SQL can express against DuckDB on the driver's tables."""

from __future__ import annotations

import duckdb
import pytest

from routeloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows(spark, name):
    c = duckdb.connect()
    for t in ("conversations", "documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = c.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*names).collect())
