from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, key string, `a.b` int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text) pairs, with further columns whose names operators use themselves."""

    def make(pairs, lang="en"):
        return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 7, "k", 1) for i, t in pairs], SCHEMA)

    return make


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


#: Null and empty texts, a null id, repeated rows, white space alone, no letters.
MESS = [(None, "some words without an id"), (1, None), (2, ""), (3, " \n\t "), (4, "12 34 ..."), (5, "a"), (5, "a"), (6, "é ñ 漢字 😀 x"), (7, "x" * 3000), (8, "word " * 2000)]
