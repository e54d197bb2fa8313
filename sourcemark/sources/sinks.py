"""Results out: receipts, reports, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Below this support a receipt says that the word itself is there; and its words.
EXPLAIN_BELOW = 0.75
EXPLAIN = "   (word is in the span; support scores its use in context)"
HOW_TO_READ = "Each anchor is the weakest support found for one word; nothing here is a verdict. Check the named source."


def quoted(text: Column) -> Column:
    """As Python writes a string: single quotes unless the text has some and no double ones."""
    plain = F.replace(F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r"))
    single, double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    return F.when(single & ~double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def receipt(a: Column) -> Column:
    """One line on an anchor."""
    head = F.format_string("%s  support %.2f", F.rpad(a["text"], F.greatest(F.length(a["text"]), F.lit(14)), F.lit(" ")), a["support"])
    nearest = F.concat(F.lit("   nearest in "), F.coalesce(F.nullif(a["evidence_id"], F.lit("")), F.lit("source")), F.lit(": "), quoted(a["evidence_text"]))
    tail = F.when(F.array_contains(a["notes"], "exact_string_in_span") & (a["support"] < EXPLAIN_BELOW), F.lit(EXPLAIN)).otherwise("")
    return F.concat(head, F.when(a["evidence_text"].isNull(), F.lit("   no anchor found")).otherwise(nearest), tail)


def report(weakest: Column, limit: int = 10) -> Column:
    return F.array_join(F.transform(F.slice(weakest, 1, limit), receipt), "\n")


def summary(df: DataFrame) -> DataFrame:
    """case_id and the text that the command line prints."""
    line = F.format_string("floor %.3f (mean of the %d weakest of %d anchors, %d of them numerals)", "floor", "k", "n_marked", "n_numeral")
    return df.select("case_id", F.concat_ws("\n", report(F.col("weakest")), line, F.concat(F.lit("encoder "), "encoder_id"), F.concat(F.lit("sha256 "), "sha256"), F.lit("not a verdict")).alias("text"))


def _dump(a: Column) -> Column:
    support = F.when(a["kind"] == "lexical", F.bround(a["support"], 6)).otherwise(a["support"])
    pair = lambda s: F.when(s.isNotNull(), F.array(s["start"], s["end"]))
    return F.struct(a["text"].alias("text"), pair(a["span"]).alias("span"), a["kind"].alias("kind"), support.alias("support"), a["value"].alias("value"), a["evidence_id"].alias("evidence_id"), a["evidence_text"].alias("evidence_text"), pair(a["evidence_span"]).alias("evidence_span"), a["notes"].alias("notes"))


def as_json(df: DataFrame) -> DataFrame:
    """case_id and one JSON document a case, nulls written out."""
    fields = [F.col(c) for c in ("floor", "k", "n_marked", "n_numeral", "encoder_id", "sha256", "warnings")]
    both = [F.transform(c, _dump).alias(c) for c in ("weakest", "anchors")]
    return df.select("case_id", F.to_json(F.struct(*fields, *both), {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def response(df: DataFrame) -> DataFrame:
    """case_id and the answer of a tool call: the weakest words, how each was checked, and the closest words in the sources."""
    one = lambda a: F.struct(a["text"].alias("word"), F.bround(a["support"], 4).alias("support"), F.when(a["kind"] == "numeral", "arithmetic").otherwise("meaning").alias("checked_by"), a["evidence_text"].alias("closest_in_sources"), a["evidence_id"].alias("source_id"), a["notes"].alias("notes"))
    fields = (F.transform("weakest", one).alias("weakest_anchors"), F.bround("floor", 4).alias("floor"), "n_marked", "encoder_id", "sha256", "warnings", F.lit(HOW_TO_READ).alias("how_to_read_this"))
    return df.select("case_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def structural_dump(units: DataFrame) -> DataFrame:
    """One JSON line a text of its units; units: locale, text, units."""
    one = lambda u: F.struct(u["kind"].alias("kind"), u["notes"].alias("notes"), F.when(u["kind"] == "numeral", u["readings"]).alias("readings"), F.array(u["start"], u["end"]).alias("span"), u["text"].alias("text"))
    return units.select(F.to_json(F.struct("locale", "text", F.transform("units", one).alias("units")), {"ignoreNullFields": "false"}).alias("json"))
