"""Every audit query against its SQL in DuckDB, on the smallest and the largest test tables."""

import math
import os

import duckdb
import pytest
from conftest import TESTDATA

from rowkeel.plans import registry
from rowkeel.sources.parquet_dir import TEST_TABLES

SQL = registry.oracle_sql()


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


@pytest.fixture(scope="module", params=["sf0.001", "sf0.1"])
def tables(request):
    path = f"{TESTDATA}/{request.param}"
    if not os.path.isdir(path):
        pytest.skip(f"no {path}")
    con = duckdb.connect()
    for t in TEST_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return path, con


def test_every_query_has_sql():
    assert set(SQL) == set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, tables, name):
    path, con = tables
    df = registry.queries()[name](spark, path)
    got = con.execute(SQL[name])
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows([d[0] for d in got.description], got.fetchall())
