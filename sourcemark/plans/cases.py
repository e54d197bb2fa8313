"""Case sets derived from the driver's tables; the oracle SQL derives the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows by their key over all cores where the table has fewer files than that.

    A small file is one row group and so one task's work, and scanning texts costs far more
    than moving them. A table of many files is left as it is read.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= cores else rows.repartition(cores, key)


def _source(text: F.Column) -> F.Column:
    return F.array(F.struct(F.concat(F.lit("invoice#"), F.col("o_orderkey")).alias("id"), text.alias("text")))


def claims(orders: DataFrame) -> DataFrame:
    """case_id, claim, total (as the source writes it) and is_defect: by key modulo 7 the claim is off by 1000, grouped as in the source, or ungrouped."""
    m, total = F.col("o_orderkey") % 7, F.col("o_totalprice")
    claim = F.when(m == 0, F.format_string("%.2f", total + 1000)).when(m <= 3, F.format_number(total, 2)).otherwise(F.format_string("%.2f", total))
    return dealt(orders.select("o_orderkey", "o_totalprice"), "o_orderkey").select("o_orderkey", F.col("o_orderkey").cast("string").alias("case_id"), claim.alias("claim"), F.format_number(total, 2).alias("total"), (m == 0).alias("is_defect"))


def invoice_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's invoice, and a sentence that repeats its total rightly or wrongly."""
    rows = claims(table(spark, sf_dir, "orders"))
    answer = F.concat(F.lit("The order "), "case_id", F.lit(" total amount due is "), "claim", F.lit(" dollars payable within 30 days"))
    source = F.concat(F.lit("Order "), "case_id", F.lit(": total amount due "), "total", F.lit(" dollars, payable within 30 days"))
    return rows.select("case_id", answer.alias("answer"), _source(source).alias("sources"), "is_defect")


def number_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of numbers alone, so that no encoder has a say."""
    rows = claims(table(spark, sf_dir, "orders"))
    answer = F.concat_ws("; ", "case_id", "claim", F.lit("30"), F.lit("45"), F.lit("12.50"))
    source = F.concat_ws("; ", "case_id", "total", F.lit("30"), F.lit("12.5"))
    return rows.select("case_id", answer.alias("answer"), _source(source).alias("sources"), "is_defect")


def conversation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn against the turns before it in its conversation."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    one = F.struct(F.concat_ws("#", "conv_id", "turn").alias("id"), F.col("text"))
    rows = dealt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "conv_id").withColumn("sources", F.collect_list(one).over(before))
    return rows.where(F.col("role") == "assistant").select(F.concat_ws("#", "conv_id", "turn").alias("case_id"), F.col("text").alias("answer"), "sources")
