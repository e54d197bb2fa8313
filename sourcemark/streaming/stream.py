"""Proofreading as a stream: a case is a row, so no state, watermark or shuffle is needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.encoders import Encoder
from ..plans.proofread import proofread
from ..sources.evidence import CASES


def read_cases(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Cases from files as they arrive in a folder."""
    return spark.readStream.schema(CASES).format(kind).load(path)


def proofread_stream(cases: DataFrame, encoder: Encoder | None, out: str, checkpoint: str, k: int = 1, kind: str = "parquet", **trigger) -> StreamingQuery:
    """Writes each case's result once; trigger as of writeStream."""
    stream = proofread(cases, encoder, k).writeStream.format(kind).option("path", out).option("checkpointLocation", checkpoint)
    return (stream.trigger(**trigger) if trigger else stream).outputMode("append").start()


def each_batch(cases: DataFrame, encoder: Encoder | None, act: Callable[[DataFrame, int], None], checkpoint: str, k: int = 1) -> StreamingQuery:
    """Hands each batch's results to `act`: calibration and other whole-table work goes there."""
    return proofread(cases, encoder, k).writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).start()
