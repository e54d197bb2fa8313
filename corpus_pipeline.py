"""A training-data pipeline over documents, in stages that each return a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sourcemark.llm import decontaminate, langid, neardup, packing, pii
from sourcemark.llm.common import col, crc_mod, table
from sourcemark.llm.queries import BYTE_BPE, PIECES


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the model is fitted on the documents table's labels."""
    labelled = table(spark, sf_dir, "documents")
    return langid.keep_identified(docs, langid.trained(labelled.where(crc_mod(col("doc_id"), 4) != 2), PIECES))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of five-word shingle sets with a similarity of 0.8 or more."""
    return neardup.one_each(docs, percent=80)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark table."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without personal data and the terms that disclose it."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [("language_id", identify_language), ("near_dedup", drop_near_duplicates), ("decontamination", decontaminate_benchmark), ("pii", redact_personal_data), ("packing", pack_sequences)]

#: SQL can't express the language model; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
