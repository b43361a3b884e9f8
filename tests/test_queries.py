"""Every query runs; those with SQL give the rows that DuckDB gives."""

from __future__ import annotations

import math
from glob import glob
from pathlib import Path

import duckdb
import pytest

from routeloom.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    f = float(v)
    return "nan" if math.isnan(f) else f"{f:.6g}"


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    assert got
    if name in ORACLE_SQL:
        cur = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(df.columns) == sorted(names)
        assert rows(df.columns, got) == rows(names, cur.fetchall())
