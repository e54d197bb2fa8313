"""The library's queries over the driver's tables, each with the same columns as its oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.encoders import TrigramEncoder
from ..operators import calibrate as K
from ..operators import numeral as N
from ..operators import rank as R
from ..operators.windows import windows
from ..sources import sinks
from ..sources.evidence import exploded as exploded_sources
from . import cases
from .cases import dealt, table
from .proofread import exploded, normalised_cases, proofread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ENCODER = TrigramEncoder()


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _joined(c: str) -> F.Column:
    return F.array_join(c, " | ").alias(c)


def _documents(spark: SparkSession, sf_dir: str, locale: str = "und") -> DataFrame:
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").withColumn("locale", F.lit(locale))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id")


def _doc_numerals(spark: SparkSession, sf_dir: str, locale: str = "und") -> DataFrame:
    return N.scanned(_documents(spark, sf_dir, locale), "doc_id")


@query
def normalise_text(spark, sf_dir):
    """Normal forms of texts with mixed line ends, invisible characters, runs of blanks and blank lines put in."""
    rough = F.concat(F.lit(" \t"), F.replace(F.replace("text", F.lit("\n"), F.lit("\r\n\n\r\n")), F.lit(" "), F.lit(" ​\t ")), F.lit("﻿ \n"))
    out = table(spark, sf_dir, "documents").select("doc_id", C.normalised(rough).alias("t"))
    return out.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@query
def numeral_scan(spark, sf_dir):
    return _doc_numerals(spark, sf_dir).select("doc_id", F.col("num_pos").cast("long").alias("num_pos"), "text", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end_pos"))


def _readings(locale: str) -> Query:
    def run(spark, sf_dir):
        return _doc_numerals(spark, sf_dir, locale).select("doc_id", F.col("start").cast("long").alias("start"), "text", _joined("readings"))

    return run


for _locale in ("und", "en", "es"):
    QUERIES[f"numeral_readings_{_locale}"] = _readings(_locale)


@query
def page_numerals(spark, sf_dir):
    """Readings in the normal form of raw pages, by page."""
    pages = dealt(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").select("page_id", C.normalised(F.col("html")).alias("text"), F.lit("und").alias("locale"))
    return N.scanned(pages, "page_id").select("page_id", F.col("start").cast("long").alias("start"), "text", _joined("readings"))


@query
def numeral_canonical(spark, sf_dir):
    """How often each canonical form occurs."""
    return _doc_numerals(spark, sf_dir).groupBy(F.array_join("readings", " | ").alias("canonical")).agg(F.count("*").alias("n"))


@query
def ambiguous_numerals(spark, sf_dir):
    found = _doc_numerals(spark, sf_dir).where((F.size("readings") > 1) | (F.size("notes") > 0))
    return found.select("doc_id", F.col("start").cast("long").alias("start"), "text", _joined("notes"))


@query
def value_set_distinct(spark, sf_dir):
    return N.value_set(_doc_numerals(spark, sf_dir))


@query
def word_scan(spark, sf_dir):
    """Words that share no character with a numeral, with their kind."""
    found = C.opened(_documents(spark, sf_dir), ["doc_id"], C.units("text", "locale"), "i", "u").where("u.kind <> 'numeral'")
    return found.select("doc_id", F.col("u.start").cast("long").alias("start"), F.col("u.end").cast("long").alias("end_pos"), F.col("u.text").alias("word"), F.col("u.kind").alias("kind"))


@query
def stopword_split(spark, sf_dir):
    found = C.opened(_turns(spark, sf_dir), [], C.units("text", F.lit("und")), "i", "u")
    return found.groupBy(F.lower("u.text").alias("word"), F.col("u.kind").alias("kind")).agg(F.count("*").alias("n"))


@query
def unit_counts(spark, sf_dir):
    u = C.units("text", "locale")
    counts = _documents(spark, sf_dir).withColumn("u", u)
    return counts.select("doc_id", F.size("u").cast("long").alias("n_units"), C.content_words(F.col("u")).cast("long").alias("n_content"), C.dropped_words("text", "locale").cast("long").alias("n_dropped"))


@query
def unsegmented_warning(spark, sf_dir):
    """Documents of which every third is followed by its own length, and every ninth by a third of it, in another script."""
    n = F.length("text")
    more = F.when(F.col("doc_id") % 9 == 0, F.repeat(F.lit("漢"), (n / 3).cast("int"))).when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("漢"), n)).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(C.segmentation_warnings(F.concat("text", more)), "|").alias("warnings"))


def _channels(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    found = normalised_cases(cases.invoice_cases(spark, sf_dir))
    answers = N.scanned(found.select("case_id", "locale", F.col("answer").alias("text")), "case_id")
    sources = N.scanned(exploded_sources(found), "case_id", "src_pos", "src_id")
    return answers, sources


@query
def numeral_support(spark, sf_dir):
    return N.supported(*_channels(spark, sf_dir)).select("case_id", "text", F.col("start").cast("long").alias("start"), "support")


@query
def nearest_numeral(spark, sf_dir):
    near = N.nearest(*_channels(spark, sf_dir))
    return near.select("case_id", F.col("num_pos").cast("long").alias("num_pos"), "evidence_id", "evidence_text", F.round("distance", 6).alias("distance"))


@query
def supported_evidence(spark, sf_dir):
    first = N.first_carrier(*_channels(spark, sf_dir))
    return first.select("case_id", F.col("num_pos").cast("long").alias("num_pos"), "evidence_id", "evidence_text")


@F.arrow_udf(T.ArrayType(T.StringType()))
def _pieces(texts: pa.Array) -> pa.Array:
    """The encoder's sub-words, in order."""
    return pa.array(([t[a:b] for a, b in ENCODER.token_spans(t)] for t in texts.to_pylist()), C.STRINGS)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _vectors(pieces: pa.Array) -> pa.Array:
    return pa.array((ENCODER.vector(p) for p in pieces.to_pylist()), pa.list_(pa.float64()))


@query
def subword_tokens(spark, sf_dir):
    """How often each sub-word occurs in the conversations."""
    out = C.opened(_turns(spark, sf_dir), [], _pieces("text"), "i", "piece")
    return out.groupBy("piece").agg(F.count("*").alias("n"))


@query
def token_windows(spark, sf_dir):
    """Windows of 16 tokens over every turn."""
    sized = _turns(spark, sf_dir).select("conv_id", "turn", F.size(_pieces("text")).alias("n_tokens"))
    return windows(sized, 16).select("conv_id", "turn", *(F.col(c).cast("long").alias(c) for c in ("first_token", "last_token")))


@query
def trigram_vector(spark, sf_dir):
    """Coordinates that aren't 0 of the benchmark's distinct sub-words."""
    pieces = C.opened(table(spark, sf_dir, "benchmark").select("text"), [], _pieces("text"), "at", "piece").select("piece").distinct()
    found = C.opened(pieces, ["piece"], _vectors("piece"), "i", "x").where("x <> 0")
    return found.select("piece", "i", F.round("x", 6).alias("x"))


@query
def max_cosine_anchor(spark, sf_dir):
    """For vectors whose id is divisible by 20 the most similar other one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return nearest_one(rows, rows.where("vec_id % 20 = 0"))


def nearest_one(rows: DataFrame, asked: DataFrame, block: int = 20_000) -> DataFrame:
    """vec_id, best_id, score: the asked vectors go to all rows in blocks of bounded size."""
    parts, out = max(1, -(-asked.count() // block)), None
    for k in range(parts):
        some = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == k).toArrow()
        ids = some.column("vec_id").to_numpy()
        shared = rows.sparkSession.sparkContext.broadcast((ids, np.array(some.column("v").to_pylist(), float).reshape(len(ids), -1)))

        def run(batches, shared=shared):
            ids, q = shared.value
            best, at = np.full(len(ids), -np.inf), np.full(len(ids), np.iinfo(np.int64).max)
            for batch in batches:
                v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                own = batch.column("vec_id").to_numpy()
                s = np.where(ids[:, None] == own[None, :], -np.inf, np.round(q @ v.T, 9)) if len(ids) else np.zeros((0, len(own)))
                top = s.max(1, initial=-np.inf)
                who = np.where(s == top[:, None], own[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
                new = (top > best) | ((top == best) & (who < at))
                best, at = np.where(new, top, best), np.where(new, who, at)
            use = np.isfinite(best)
            yield pa.RecordBatch.from_pydict({"vec_id": ids[use], "best_id": at[use], "score": best[use]})

        found = rows.mapInArrow(run, "vec_id long, best_id long, score double")
        out = found if out is None else out.unionByName(found)
    top = F.max_by(F.struct("best_id", "score"), F.struct("score", -F.col("best_id")))
    return out.groupBy("vec_id").agg(top.alias("x")).select("vec_id", "x.best_id", F.round("x.score", 6).alias("score"))


def _numbers(spark, sf_dir, k: int = 1) -> DataFrame:
    return proofread(cases.number_cases(spark, sf_dir), None, k)


@query
def anchor_union(spark, sf_dir):
    """Every unit of every answer with its support and evidence."""
    return exploded(_numbers(spark, sf_dir)).select("case_id", F.col("ordinal").cast("long").alias("ordinal"), "text", "kind", "support", "evidence_id", "evidence_text", _joined("notes"))


@query
def weakest_topk(spark, sf_dir):
    out = R.weakest(exploded(_numbers(spark, sf_dir)), 2)
    return out.select("case_id", F.col("r").cast("long").alias("r"), "text", "support")


@query
def adaptive_k(spark, sf_dir):
    """k by the number of content words of each conversation turn."""
    n = C.content_words(C.units("text", F.lit("und")))
    out = _turns(spark, sf_dir).select("conv_id", "turn", n.alias("n"))
    return out.select("conv_id", "turn", F.col("n").cast("long").alias("n_marked"), C.resolved_k(F.lit(0), F.col("n")).cast("long").alias("k"))


@query
def floor_per_case(spark, sf_dir):
    return _numbers(spark, sf_dir, 2).select("case_id", F.round("floor", 6).alias("floor"), *(F.col(c).cast("long").alias(c) for c in ("k", "n_marked", "n_numeral")))


@query
def floor_exploded(spark, sf_dir):
    """The same floors by windows over exploded anchors."""
    found = R.floors(cases.number_cases(spark, sf_dir), exploded(_numbers(spark, sf_dir)), 2)
    return found.select("case_id", F.round("floor", 6).alias("floor"), *(F.col(c).cast("long").alias(c) for c in ("k", "n_marked", "n_numeral")))


@query
def floor_vs_mean(spark, sf_dir):
    """How far the weakest anchor lies below the mean of all."""
    return _numbers(spark, sf_dir).select("case_id", F.round("floor", 6).alias("floor"), F.round(R.mean_support(R.marked(F.col("anchors"))), 6).alias("mean"))


@query
def receipt_lines(spark, sf_dir):
    return _numbers(spark, sf_dir, 2).select("case_id", sinks.report(F.col("weakest")).alias("report"))


@query
def no_context_warning(spark, sf_dir):
    """Cases of which every fifth has lost its source's text."""
    some = cases.number_cases(spark, sf_dir)
    bare = F.transform("sources", lambda s: F.struct(s["id"].alias("id"), F.when(F.col("case_id").cast("long") % 5 == 0, F.lit(" \n")).otherwise(s["text"]).alias("text")))
    return proofread(some.withColumn("sources", bare), None).select("case_id", F.array_join("warnings", "|").alias("warnings"), "floor")


@query
def content_hash(spark, sf_dir):
    return _numbers(spark, sf_dir).select("case_id", "sha256")


def _labelled(spark, sf_dir) -> DataFrame:
    found = cases.number_cases(spark, sf_dir)
    return proofread(found, None, 3).select("case_id", "floor").join(found.select("case_id", "is_defect"), "case_id")


@query
def calibrate_threshold(spark, sf_dir):
    return K.thresholds(_labelled(spark, sf_dir), 0.95).select(F.round("threshold", 6).alias("threshold"), "target_recall", "n", "n_positive")


@query
def calibrate_recall_fpr(spark, sf_dir):
    """By the last digit of the case."""
    rows = _labelled(spark, sf_dir).withColumn("digit", F.substring("case_id", -1, 1))
    return K.thresholds(rows, 0.95, "digit").select("digit", *(F.round(c, 6).alias(c) for c in ("threshold", "achieved_recall", "fpr")))


@query
def calibrate_bootstrap(spark, sf_dir):
    """Intervals by the last digit of the case; the label goes along in the id, so nothing is joined."""
    found = cases.number_cases(spark, sf_dir).withColumn("case_id", F.struct("case_id", "is_defect"))
    rows = proofread(found, None, 3).select("case_id.*", "floor").withColumn("digit", F.substring("case_id", -1, 1))
    return K.calibrate(rows, by=("digit",), min_labelled=2, order=F.col("case_id").cast("long"))


@query
def lexical_support(spark, sf_dir):
    """Every word of the assistant's turns with its best support in the turns before."""
    found = exploded(proofread(cases.conversation_cases(spark, sf_dir), ENCODER, 0))
    return found.where("kind = 'lexical'").select("case_id", F.col("ordinal").cast("long").alias("ordinal"), "text", F.round("support", 6).alias("support"), "evidence_id", "evidence_text", _joined("notes"))


@query
def exact_string_note(spark, sf_dir):
    """Words whose own text stands in the source of their evidence."""
    found = lexical_support(spark, sf_dir)
    return found.groupBy((F.instr("notes", "exact_string_in_span") > 0).alias("exact")).agg(F.count("*").alias("n"), F.round(F.min("support"), 6).alias("least"))


class LongRuns(TrigramEncoder):
    """Tokens of runs of at least four characters only, so that shorter words meet none."""

    _WORD = re.compile(r"\w{4,}")


@query
def unaligned_guard(spark, sf_dir):
    """What is said of cases with a word that no token of the answer meets."""
    out = proofread(cases.conversation_cases(spark, sf_dir), LongRuns(), 0)
    return out.where(F.col("error").isNotNull()).select("case_id", "error", F.col("floor").isNull().alias("no_floor"))


@query
def proofread_invoices(spark, sf_dir):
    """Everything about the invoice cases: words and numbers."""
    out = proofread(cases.invoice_cases(spark, sf_dir), ENCODER, 0)
    return out.select("case_id", F.round("floor", 6).alias("floor"), "k", "n_marked", "n_numeral", "encoder_id", sinks.report(F.col("weakest")).alias("report"), F.array_join("warnings", "|").alias("warnings"))


@query
def case_json(spark, sf_dir):
    return sinks.as_json(_numbers(spark, sf_dir))
