"""Every core query runs on the smallest tables and agrees with its SQL."""

import os

import pytest

from stanzaflow.plans import registry

duckdb = pytest.importorskip("duckdb")
NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{small}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, con, name):
    df = registry.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql:
        cur = con.execute(sql)
        at = [[d[0] for d in cur.description].index(c) for c in cols]
        assert got == sorted(repr([plain(r[i]) for i in at]) for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
