"""Every query with SQL, held against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from inkmeter import queries as library

from .conftest import SF


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(library.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = library.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(library.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    a = sorted(repr(tuple(map(plain, r))) for r in got.select(cols).collect())
    b = sorted(repr(tuple(plain(r[k]) for k in at)) for r in want.fetchall())
    assert a == b


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_full_audit_invariants(spark):
    rows = library.full_audit(spark, SF).collect()
    assert len(rows) == 200 and all(0 <= r.score <= 100 for r in rows) and {r.tier for r in rows} <= set(library.V.TIERS)
