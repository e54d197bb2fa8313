from __future__ import annotations

import re

import __spark_entry__ as entry


def test_ten_operators_and_the_pipeline():
    names = list(entry.queries())
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 11))
    assert "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
