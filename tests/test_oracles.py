"""Every registered query with SQL gives what DuckDB gives, over the smallest tables."""

import os

import duckdb
import pytest

import siltstone.plans  # noqa: F401  registers every query
from siltstone.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "labels", "pages", "conversations")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (bool, int, str)) or v is None:
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return round(float(v), 9)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    o = con.execute(registry.ORACLES[name])
    names = [x[0] for x in o.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in o.fetchall()), key=repr)
    assert got == want
