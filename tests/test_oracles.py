"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

from sparkfolio.plans import registry

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def rows(cells):
    return sorted(([round(x, 6) if isinstance(x, float) else x for x in r] for r in cells), key=repr)


@needs_data
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert rows(got.select(*order).collect()) == rows(want.select(*(f'"{c}"' for c in order)).fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() >= 0


def test_entry_points(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if os.path.isdir(DATA):
        assert __spark_entry__.entry(spark).count() > 0
