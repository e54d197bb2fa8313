"""Column functions over texts: Arrow UDFs where Spark has no equal, plain expressions elsewhere."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from . import scan

# types, not DDL: workers import this module, and DDL is parsed on the driver
_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())
_PLACE = [T.StructField("text", _TEXT), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
_READ = [T.StructField("readings", _TEXTS), T.StructField("notes", _TEXTS)]
NUMERALS = T.ArrayType(T.StructType([*_PLACE, *_READ]))
UNITS = T.ArrayType(T.StructType([*_PLACE, T.StructField("kind", _TEXT), *_READ]))
#: Python's white space at the ends of a text, as a Java character class.
_SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@arrow_udf(_TEXT)
def nfkc(texts: pa.Array) -> pa.Array:
    return pa.array((t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()), pa.string())


def normalised(text: Column) -> Column:
    """The normal form that all offsets refer to; null stays null."""
    out = nfkc(F.regexp_replace(text, "\r\n?", "\n"))
    out = F.translate(out, scan.INVISIBLE, "")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t\x0B\f]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, f"^{_SPACE}|{_SPACE}$", "")


def listed(lists: Iterable[Sequence[tuple] | None], names: Sequence[str], kinds: Sequence[pa.DataType]) -> pa.ListArray:
    """Lists of tuples as an array of lists of structs, built field by field; None is a null list."""
    flat, offsets = [], [0]
    for rows in lists:
        if rows is None:
            offsets[-1:] = [None, len(flat)]
        else:
            flat += rows
            offsets.append(len(flat))
    fields = [pa.array(x, kind) for x, kind in zip(zip(*flat), kinds, strict=True)] if flat else [pa.array([], kind) for kind in kinds]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, list(names)))


STRINGS = pa.list_(pa.string())
_KINDS = {"text": pa.string(), "start": pa.int32(), "end": pa.int32(), "kind": pa.string(), "readings": STRINGS, "notes": STRINGS}


def _found(scanner, row: type, texts: pa.Array, locales: pa.Array) -> pa.ListArray:
    found = (None if t is None else scanner(t, x) for t, x in zip(texts.to_pylist(), locales.to_pylist(), strict=True))
    return listed(found, row._fields, [_KINDS[f] for f in row._fields])


@arrow_udf(NUMERALS)
def numerals(texts: pa.Array, locales: pa.Array) -> pa.Array:
    return _found(scan.numerals, scan.Numeral, texts, locales)


@arrow_udf(UNITS)
def units(texts: pa.Array, locales: pa.Array) -> pa.Array:
    return _found(scan.units, scan.Unit, texts, locales)


@arrow_udf(T.IntegerType())
def dropped_words(texts: pa.Array, locales: pa.Array) -> pa.Array:
    return pa.array((None if t is None else scan.dropped_words(t, x) for t, x in zip(texts.to_pylist(), locales.to_pylist(), strict=True)), pa.int32())


def opened(df: DataFrame, keys: Sequence[str], found: Column | str, at: str, item: str) -> DataFrame:
    """keys, place and item, one row an item of a list that a UDF has made.

    Outer and then filtered: for a plain generator a filter on the list's size is inferred,
    which runs the UDF once more, below any exchange.
    """
    return df.select(*keys, F.posexplode_outer(found).alias(at, item)).where(F.col(at).isNotNull())


def is_normalised(text: Column) -> Column:
    return normalised(text) == text


def segmentation_warnings(text: Column) -> Column:
    """One fixed warning where more than the share of code points is in an unsegmented script."""
    many = F.regexp_count(text, F.lit(scan.UNSEGMENTED.pattern)) > scan.UNSEGMENTED_SHARE * F.length(text)
    return F.when(many, F.array(F.lit(scan.UNSEGMENTED_WARNING))).otherwise(F.expr("cast(array() as array<string>)"))


def canonical_readings(numeral: Column) -> Column:
    return F.array_join(numeral["readings"], " | ")


def ambiguous(numeral: Column) -> Column:
    return F.size(numeral["readings"]) > 1


def matches(readings: Column, values: Column) -> Column:
    """Whether any reading is among the values: exact, with no tolerance."""
    return F.arrays_overlap(readings, values)


def content_words(found: Column) -> Column:
    return F.size(F.filter(found, lambda u: u["kind"] != "skipped"))


def adaptive_k(n: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(4), F.ceil(F.lit(0.15) * n).cast("int")))


def resolved_k(k: Column, marked: Column) -> Column:
    """0: adaptive; below 1: 1; never more than there is."""
    return F.least(F.when(k == 0, adaptive_k(marked)).otherwise(F.greatest(F.lit(1), k)), marked).cast("int")


def register(spark: SparkSession) -> None:
    """The functions for use in SQL."""
    spark.udf.register("numerals", numerals)
    spark.udf.register("units", units)
    spark.udf.register("dropped_words", dropped_words)
    spark.udf.register("nfkc", nfkc)
