"""Whole cases: normal forms, anchors, floor, warnings, hash; one row in, one row out, no shuffle."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import scan
from ..functions.encoders import Encoder
from ..functions.hashing import content_hashes
from ..operators import rank
from ..operators.anchors import ANCHOR, anchors
from ..sources.evidence import with_ids

MAX_ANCHORS = 2048


def normalised_cases(cases: DataFrame, k: int = 1, locale: str = "und") -> DataFrame:
    """Cases with answer and sources in normal form; columns k and locale are added where missing."""
    out = cases if "k" in cases.columns else cases.withColumn("k", F.lit(k))
    out = out if "locale" in out.columns else out.withColumn("locale", F.lit(locale))
    known = F.lower(F.coalesce("locale", F.lit("und")))
    out = out.withColumn("locale", F.when(known.isin(*scan.LOCALES), known).otherwise(F.raise_error(F.concat(F.lit("unknown locale "), "locale"))))

    # texts are laid side by side, made normal in one call, and put back
    texts = F.concat(F.array(F.coalesce("answer", F.lit(""))), F.transform("sources", lambda s: s["text"]))
    out = out.withColumn("sources", with_ids(F.coalesce("sources", F.expr("cast(array() as array<struct<id:string,text:string>>)"))))
    return out.withColumn("texts", normal_array(texts)).withColumn("answer", F.element_at("texts", 1)).withColumn("sources", F.zip_with("sources", F.slice("texts", 2, 1 << 30), lambda s, t: F.struct(s["id"].alias("id"), t.alias("text")))).drop("texts")


@F.arrow_udf(T.ArrayType(T.StringType()))
def normal_array(lists: pa.Array) -> pa.Array:
    return pa.array(([scan.normalised(t or "") for t in ts] for ts in lists.to_pylist()), C.STRINGS)


def all_warnings() -> F.Column:
    none = ~F.exists("sources", lambda s: s["text"] != "")
    empty = F.expr("cast(array() as array<string>)")
    return F.concat(C.segmentation_warnings(F.col("answer")), F.when(none, F.array(F.lit(scan.NO_CONTEXT_WARNING))).otherwise(empty))


def proofread(cases: DataFrame, encoder: Encoder | None, k: int = 1, locale: str = "und", max_anchors: int = MAX_ANCHORS, strict: bool = False) -> DataFrame:
    """Per case: floor, k, weakest, anchors, n_marked, n_numeral, encoder_id, sha256, warnings, error.

    cases: case_id, answer, sources (array of id and text), and k and locale if they
    differ by case. k=0 picks it by the answer's length. A case with more than
    max_anchors scoring words, or whose tokens miss a word, has nulls and an error; strict
    makes that fail the job.
    """
    name = encoder.id if encoder else "none"
    out = normalised_cases(cases, k, locale)
    out = out.withColumn("found", anchors(F.col("answer"), F.col("sources"), F.col("locale"), encoder, max_anchors))
    out = out.withColumn("warnings", all_warnings()).withColumn("anchors", F.col("found.anchors")).withColumn("error", F.col("found.error"))
    if strict:
        out = out.withColumn("anchors", F.when(F.col("error").isNull(), F.col("anchors")).otherwise(F.raise_error(F.col("error")).cast(f"array<{ANCHOR}>")))
    out = out.withColumn("marked", rank.ordered(rank.marked(F.col("anchors")))).withColumn("n_marked", F.size("marked"))
    out = out.withColumn("k", C.resolved_k(F.col("k"), F.col("n_marked"))).withColumn("weakest", F.when(F.col("k") > 0, F.slice("marked", 1, F.col("k"))).otherwise(F.slice("marked", 1, 0)))
    sha = content_hashes("anchors", "k", F.lit(name), "warnings")
    good = F.col("error").isNull()
    return out.select(
        "case_id",
        F.when(good, rank.mean_support(F.col("weakest"))).alias("floor"),
        F.when(good, F.col("k")).alias("k"),
        "weakest",
        "anchors",
        F.when(good, F.col("n_marked")).alias("n_marked"),
        F.when(good, F.size(F.filter("marked", lambda a: a["kind"] == "numeral"))).alias("n_numeral"),
        F.lit(name).alias("encoder_id"),
        sha.alias("sha256"),
        "warnings",
        "error",
    )


def exploded(results: DataFrame) -> DataFrame:
    """One row an anchor, in the answer's order: case_id, ordinal and the anchor's fields, start and end."""
    return C.opened(results, ["case_id"], "anchors", "ordinal", "a").select("case_id", "ordinal", "a.*").withColumn("start", F.col("span.start")).withColumn("end", F.col("span.end"))
