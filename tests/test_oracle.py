"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from parlance.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    return c


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=repr)
    r = duck.execute(catalog.ORACLE[name])
    at = [[d[0] for d in r.description].index(c) for c in columns]
    assert got == sorted((tuple(rounded(x[i]) for i in at) for x in r.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0
