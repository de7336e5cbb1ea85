"""The pN_ queries on the smallest tables: against SQL where there is one."""

import os

import duckdb
import pytest

from parlance.llm import oracle, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_oracle(spark, name):
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    r = c.execute(oracle.ORACLE[name])
    at = [[d[0] for d in r.description].index(x) for x in columns]
    assert sorted((tuple(r[x] for x in columns) for r in df.collect()), key=repr) == sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["p1_found", "p4_found", "p6_found", "p7_fill", "p8_shares"])
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0
