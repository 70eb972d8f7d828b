"""The contract queries that SQL can express, against that SQL on whole tables."""

from __future__ import annotations

import os

import pytest

from trawl.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DATA).toArrow(), con.execute(queries.oracle_sql()[name]).to_arrow_table()
    cols = sorted(got.column_names)
    assert cols == sorted(want.column_names)
    rows = lambda table: sorted(tuple(str(r[c]) for c in cols) for r in table.to_pylist())
    assert rows(got) == rows(want)
