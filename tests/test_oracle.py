"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from quarry.plans import queries as base

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(([r[i] for i in order] for r in data), key=lambda r: [repr(x) for x in r])


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(base.SQL))
def test_matches_sql(spark, duck, name):
    found = base.QUERIES[name](spark, DIR)
    wanted = duck.sql(base.SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    got, want = rows(found.columns, [tuple(r) for r in found.collect()]), rows(list(wanted.columns), wanted.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(same(x, y) for x, y in zip(g, w, strict=True)), (g, w)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "test_name" in df.columns


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
