"""Marked stretches of texts: their arrays, their text form and counts.

A span is a struct (s, k, f): start, kind's place in a list of names, end; code
points, end exclusive, so sorting structs sorts by start and then by kind.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "array<struct<s:int,k:int,f:int>>"
ARROW = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("f", pa.int32())]))


def structs(spans: list[tuple[int, int, int]]) -> list[dict]:
    return [{"s": s, "k": k, "f": f} for s, k, f in spans]


def as_text(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array([F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["f"].cast("string"))), ",")


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("long")


def digest(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.sha2(as_text(spans, kinds).cast("binary"), 256)
