"""Every registered query of the library's own operators: runs, and equals its SQL where it has one."""

from __future__ import annotations

import os

import pytest

import __spark_entry__
from trawl.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(str(x) for x in r) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    assert len(got) > 0
    if name in registry.ORACLES:
        assert rows(got) == rows(duck.execute(registry.ORACLES[name]).df())


def test_entry_and_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.ORACLES) <= set(__spark_entry__.oracle_sql()) and set(registry.QUERIES) <= set(__spark_entry__.queries())
