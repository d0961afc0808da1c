"""Every query of the reference's own operators against its DuckDB twin, at the smallest scale."""

import math
import os

import duckdb
import pytest

from factforge.plans.base import TABLES
from factforge.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_twin(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    twin = duck.sql(ORACLE_SQL[name])
    assert sorted(twin.columns) == columns
    at = [twin.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in twin.fetchall()), key=repr)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE_SQL)
