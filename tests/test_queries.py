"""Each registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from driftline.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return round(float(v), 5) + 0.0 if not math.isnan(v) else "nan"
    return str(v)


def rows(names, got):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in got)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    want = duck.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_components_against_union_find(spark):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for r in registry.table(spark, FOLDER, "lineitem").select("l_orderkey", "l_partkey").collect():
        a, b = root(r.l_orderkey), root(-r.l_partkey)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in registry.QUERIES["components_of_orders_and_parts"](spark, FOLDER).collect()}
    assert got == {x: root(x) for x in up}
