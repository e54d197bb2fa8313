"""Count-based windows over a text's tokens, as generated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def starts(n: Column, limit: int) -> Column:
    """First tokens of windows of `limit` that overlap by half, until the last token is in one; none of none."""
    step = max(1, limit // 2)
    more = F.ceil(F.greatest(n - limit, F.lit(0)) / step).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), more * step, F.lit(step))).otherwise(F.expr("cast(array() as array<int>)"))


def windows(tokens: DataFrame, limit: int, n: str = "n_tokens") -> DataFrame:
    """One row a window: tokens' columns, first_token and last_token (exclusive)."""
    return tokens.select("*", F.explode(starts(F.col(n).cast("int"), limit)).alias("first_token")).withColumn("last_token", F.least(F.col("first_token") + limit, F.col(n).cast("int")))
