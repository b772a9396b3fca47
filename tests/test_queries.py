"""Every query with SQL against DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from plumbago.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)

    def plain(v):
        return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v

    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        path = f"{p}/*.parquet" if p.is_dir() else p
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())
