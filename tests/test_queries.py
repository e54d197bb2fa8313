"""Every query against its oracle, over whole tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from sourcemark.plans.oracles import ORACLES
from sourcemark.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, small, name):
    got = QUERIES[name](spark, small)
    names = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr)
    if name in ORACLES:
        there = con.sql(ORACLES[name])
        at = [there.columns.index(c) for c in names]
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in there.fetchall()), key=repr)
    assert rows
