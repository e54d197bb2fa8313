"""Sources in: what a caller may pass as context, files or literals, and DataFrames of cases."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCES = "array<struct<id:string,text:string>>"
CASES = f"case_id string, answer string, sources {SOURCES}, k int, locale string"


class Evidence(NamedTuple):
    id: str
    text: str


def as_evidence(context: str | Sequence) -> tuple[Evidence, ...]:
    """A text, or a list of texts, (id, text) pairs and Evidence; a text without an id is ctx-{place}."""

    def source(place: int, item) -> Evidence:
        pair = (f"ctx-{place}", item) if isinstance(item, str) else item
        if not isinstance(pair, tuple) or len(pair) != len(Evidence._fields):
            raise TypeError(f"context[{place}] is a {type(item).__name__}; expected a text, an (id, text) tuple or Evidence")
        return Evidence(*map(str, pair))

    return tuple(source(*x) for x in enumerate([context] if isinstance(context, str) else context))


def text_or_file(value: str) -> str:
    """The content of a file of that name if there is one, else the value itself."""
    try:
        path = Path(value)
        return path.read_text(encoding="utf-8") if path.is_file() else value
    except OSError:
        return value


def named_source(value: str, place: int) -> Evidence:
    """`id=file`, or a file or text, which is ctx-{place}."""
    name, found, path = value.partition("=")
    try:
        if found and Path(path).is_file():
            return Evidence(name, text_or_file(path))
    except OSError:
        pass
    return Evidence(f"ctx-{place}", text_or_file(value))


def case_rows(spark: SparkSession, rows: Sequence[tuple], k: int = 1, locale: str = "und") -> DataFrame:
    """A DataFrame of (case_id, answer, context) rows."""
    return spark.createDataFrame([(str(c), a, [tuple(e) for e in as_evidence(x)], k, locale) for c, a, x in rows], CASES)


def with_ids(sources: Column) -> Column:
    """Sources whose missing or empty ids are ctx-{place}, and whose missing texts are empty."""
    return F.transform(sources, lambda s, i: F.struct(F.coalesce(F.nullif(s["id"], F.lit("")), F.concat(F.lit("ctx-"), i)).alias("id"), F.coalesce(s["text"], F.lit("")).alias("text")))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """id (the file's name) and text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("id"), F.col("value").alias("text"))


def exploded(cases: DataFrame) -> DataFrame:
    """One row a source: case_id, locale, src_pos, src_id, text."""
    return cases.select("case_id", "locale", F.posexplode(with_ids(F.col("sources"))).alias("src_pos", "s")).select("case_id", "locale", "src_pos", F.col("s.id").alias("src_id"), F.col("s.text").alias("text"))
