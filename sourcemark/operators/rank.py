"""Ranking anchors and the floor: as array expressions inside a case, and over exploded anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def marked(anchors: Column) -> Column:
    return F.filter(anchors, lambda a: a["kind"] != "skipped")


def ordered(anchors: Column) -> Column:
    """Weakest first; at one support numerals, then by place."""
    keyed = F.transform(anchors, lambda a: F.struct(a["support"], a["kind"] != "numeral", a["span"]["start"], a["span"]["end"], a.alias("anchor")))
    return F.transform(F.array_sort(keyed), lambda x: x["anchor"])


def mean_support(anchors: Column) -> Column:
    """1.0 if there are none."""
    total = F.aggregate(anchors, F.lit(0.0), lambda s, a: s + a["support"])
    return F.when(F.size(anchors) > 0, total / F.size(anchors)).otherwise(1.0)


def weakest(exploded: DataFrame, k: int | Column, most: int = 4) -> DataFrame:
    """The k weakest rows of each case with their rank r; exploded: case_id, kind, support, start, end.

    The literal bound lets each task keep only its own first rows before the shuffle.
    """
    most = max(most, k) if isinstance(k, int) else most
    by = Window.partitionBy("case_id").orderBy("support", F.col("kind") != "numeral", "start", "end")
    return exploded.where(F.col("kind") != "skipped").withColumn("r", F.row_number().over(by)).where((F.col("r") <= most) & (F.col("r") <= k))


def floors(cases: DataFrame, exploded: DataFrame, k: int) -> DataFrame:
    """case_id, k, floor, n_marked, n_numeral of every case; k as in proofread.

    Counts and ranks come from one exchange; a case's group is bounded by its max_anchors.
    """
    whole = Window.partitionBy("case_id")
    order = whole.orderBy("support", F.col("kind") != "numeral", "start", "end")
    rows = exploded.where(F.col("kind") != "skipped").select("case_id", "kind", "support", "start", "end")
    rows = rows.withColumn("n_marked", F.count("*").over(whole)).withColumn("n_numeral", F.count_if(F.col("kind") == "numeral").over(whole))
    rows = rows.withColumn("k", C.resolved_k(F.lit(k), F.col("n_marked"))).withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("k"))
    found = rows.groupBy("case_id").agg(*(F.first(c).alias(c) for c in ("k", "n_marked", "n_numeral")), F.avg("support").alias("floor"))
    zero = [F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("n_marked", "n_numeral")]
    return cases.select("case_id").join(found, "case_id", "left").select("case_id", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("floor", F.lit(1.0)).alias("floor"), *zero)
