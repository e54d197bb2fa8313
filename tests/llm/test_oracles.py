"""Operators with SQL against it, over whole tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from sourcemark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, small, name):
    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = QUERIES[name](spark, small)
    names = sorted(got.columns)
    there = con.sql(ORACLES[name])
    assert names == sorted(there.columns)
    at = [there.columns.index(c) for c in names]
    rows = sorted(tuple(r[c] for c in names) for r in got.collect())
    assert rows == sorted(tuple(r[i] for i in at) for r in there.fetchall())
    assert rows
