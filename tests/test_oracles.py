"""Every registered query with an oracle agrees with DuckDB on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from scriptorium import registry


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return round(float(v), 5)
    if isinstance(v, datetime.datetime):
        return str(v)
    return float(v) if type(v).__name__ == "Decimal" else str(v)


def rows(found, columns, order):
    return sorted(repr([normal(r[columns.index(c)]) for c in order]) for r in found)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    order = sorted(df.columns)
    got = rows([tuple(r) for r in df.collect()], df.columns, order)
    if name in registry.oracle_sql():
        want = duck.sql(registry.oracle_sql()[name])
        assert sorted(want.columns) == order
        assert got == rows(want.fetchall(), want.columns, order)
    else:
        assert got
