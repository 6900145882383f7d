"""Every query against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pytest

from thicket import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    return v


def rows(table):
    names = sorted(table.schema.names)
    return names, Counter(tuple(plain(r[c]) for c in names) for r in table.to_pylist())


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        p = f"{small}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(name, spark, small, con):
    got = rows(plans.QUERIES[name](spark, small).toArrow())
    want = rows(con.sql(plans.SQL[name]).to_arrow_table())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs_twice_alike(name, spark, small):
    one, two = (rows(plans.QUERIES[name](spark, small).toArrow()) for _ in range(2))
    assert one == two and sum(one[1].values()) > 0
