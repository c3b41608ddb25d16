"""The queries that SQL can express, against DuckDB on whole tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from quillon.llm.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(found.fetchall())


def test_thirteen_operators():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and len(QUERIES) == 13
