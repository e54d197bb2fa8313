"""The content hash of a case: of every field of its anchors' struct, with how they were made."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# The layout's version and the decimals of a lexical support.
VERSION, DECIMALS = 1, 6

#: Sorted keys, no spaces, no escapes; NaN is refused.
compact_json = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode


def _plain(x: Any, decimals: int | None) -> Any:
    """A field as JSON has it: a span as a pair, a number as a float, a list's items as texts."""
    match x:
        case None | str():
            return x
        case {"start": start, "end": end}:
            return [int(start), int(end)]
        case float():
            return float(x) if decimals is None else round(float(x), decimals)
    return [str(item) for item in x]


@pandas_udf(StringType())
def content_hashes(anchors: pd.Series, k: pd.Series, encoder_id: pd.Series, warnings: pd.Series) -> pd.Series:
    def digest(found, k, encoder_id, warnings):
        if found is None:
            return None
        fields = [{name: _plain(x, DECIMALS if a["kind"] == "lexical" else None) for name, x in a.items()} for a in found]
        whole = {"version": VERSION, "k": int(k), "encoder_id": encoder_id, "warnings": _plain(warnings, None), "anchors": fields}
        return hashlib.sha256(compact_json(whole).encode()).hexdigest()

    return pd.Series(map(digest, anchors, k, encoder_id, warnings), index=anchors.index, dtype=object)
