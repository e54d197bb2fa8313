"""The numeral channel as joins over exploded numerals, for sources that aren't nested in their cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def scanned(texts: DataFrame, *keys: str) -> DataFrame:
    """One row a numeral of texts (keys, locale, text): keys, num_pos and the numeral's fields."""
    return C.opened(texts, keys, C.numerals("text", "locale"), "num_pos", "n").select(*keys, "num_pos", "n.*")


def read(numerals: DataFrame, *keys: str) -> DataFrame:
    """One row a reading: keys, num_pos, text, start, end, rd_pos, reading."""
    return numerals.select(*keys, "num_pos", "text", "start", "end", F.posexplode("readings").alias("rd_pos", "reading"))


def value_set(numerals: DataFrame, *by: str) -> DataFrame:
    """Distinct readings."""
    return numerals.select(*by, F.explode("readings").alias("reading")).distinct()


def supported(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answers with support: 1.0 where a reading is among the case's source readings, exactly, else 0.0.

    answers, sources: case_id, num_pos, readings, ...; an equi-join on (case_id, reading), so
    large cases spread over their values.
    """
    theirs = value_set(sources, "case_id").withColumn("hit", F.lit(1.0))
    looked = answers.withColumn("reading", F.explode("readings")).join(theirs, ["case_id", "reading"], "left")
    rest = [c for c in answers.columns if c not in ("case_id", "num_pos")]
    out = looked.groupBy("case_id", "num_pos").agg(*(F.first(c).alias(c) for c in rest), F.coalesce(F.max("hit"), F.lit(0.0)).alias("support"))
    return out.select(*answers.columns, "support")


def first_carrier(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """case_id, num_pos, evidence_id, evidence_text of the first source numeral that shares a reading."""
    mine = answers.select("case_id", "num_pos", F.explode("readings").alias("reading"))
    theirs = sources.select("case_id", "src_pos", "src_id", F.col("num_pos").alias("src_num"), "text", F.explode("readings").alias("reading"))
    first = F.min_by(F.struct("src_id", "text"), F.struct("src_pos", "src_num"))
    return mine.join(theirs, ["case_id", "reading"]).groupBy("case_id", "num_pos").agg(first.alias("e")).select("case_id", "num_pos", F.col("e.src_id").alias("evidence_id"), F.col("e.text").alias("evidence_text"))


def nearest(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """case_id, num_pos, evidence_id, evidence_text, distance of the source numeral with the least relative distance to the first reading."""
    v, r = F.element_at("readings", 1).cast("double"), F.col("reading").cast("double")
    mine = answers.select("case_id", "num_pos", v.alias("v"))
    theirs = sources.select("case_id", "src_pos", "src_id", F.col("num_pos").alias("src_num"), "text", F.posexplode("readings").alias("rd_pos", "reading"))
    far = F.abs(r - F.col("v")) / F.greatest(F.abs(r), F.abs("v"), F.lit(1.0))
    pair = mine.join(theirs, "case_id").withColumn("distance", far)
    best = F.min_by(F.struct("src_id", "text", "distance"), F.struct("distance", "src_pos", "src_num", "rd_pos"))
    return pair.groupBy("case_id", "num_pos").agg(best.alias("e")).select("case_id", "num_pos", F.col("e.src_id").alias("evidence_id"), F.col("e.text").alias("evidence_text"), F.col("e.distance").alias("distance"))
