"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def names():
    from claimlens.plans import registry

    return sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from claimlens.plans import registry

    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    q = duck.execute(registry.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(q.description)}
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
    assert sorted(at) == cols
    assert sorted([show(x) for x in r] for r in df.select(*cols).collect()) == sorted([show(r[at[k]]) for k in cols] for r in q.fetchall())
