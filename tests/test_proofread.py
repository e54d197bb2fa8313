from __future__ import annotations

import json

import pytest

from pyspark.sql import functions as F

from sourcemark import TrigramEncoder, proofread
from sourcemark.functions.hashing import compact_json
from sourcemark.plans.proofread import exploded
from sourcemark.sources import sinks
from sourcemark.sources.evidence import Evidence, as_evidence, case_rows, named_source, text_or_file

SOURCE = "The invoice total amount due is 10,000 dollars, payable within 30 days."
GOOD = "The total amount due is 10,000 dollars payable within 30 days."


def one(spark, answer, context, k=1, locale="und", **more):
    return proofread(case_rows(spark, [("c", answer, context)], k, locale), TrigramEncoder(), **more).first()


def test_grounded_perturbed_and_reformatted(spark):
    cases = [("good", GOOD, SOURCE), ("bad", GOOD.replace("10,000", "1,000"), SOURCE), ("form", GOOD.replace("10,000", "10000"), SOURCE)]
    got = {r.case_id: r for r in proofread(case_rows(spark, cases), TrigramEncoder()).collect()}
    assert got["good"].floor == pytest.approx(1) == got["form"].floor
    bad = got["bad"]
    assert bad.floor == 0
    assert (bad.weakest[0].text, bad.weakest[0].evidence_text, bad.weakest[0].evidence_id) == ("1,000", "10,000", "ctx-0")
    assert sum(a.support for a in bad.anchors) / len(bad.anchors) > 0.85
    assert got["good"].sha256 != bad.sha256


def test_numerals_win_ties_and_k(spark):
    got = one(spark, "the 1,000 dollars zzzqqx", SOURCE, k=9)
    assert got.weakest[0].text == "1,000"
    assert got.k == got.n_marked == 3
    assert one(spark, GOOD, SOURCE, k=-3).k == 1
    assert one(spark, " ".join(f"word{chr(97 + i)}" for i in range(20)), SOURCE, k=0).k == 3


def test_empty_edges(spark):
    nothing = one(spark, "of the", [])
    assert (nothing.floor, nothing.k, nothing.n_marked, nothing.weakest) == (1.0, 0, 0, [])
    bare = one(spark, "words and 1,234", [("s", " \n")])
    assert bare.floor == 0
    assert "no context" in bare.warnings[0]
    assert all(a.evidence_id is None for a in bare.anchors)
    cjk = one(spark, "日本語の文章です", "x")
    assert "unsegmented" in cjk.warnings[0]


def test_errors_are_rows_unless_strict(spark):
    cases = case_rows(spark, [("c", "one red word today", SOURCE), ("d", "word", SOURCE)])
    got = {r.case_id: r for r in proofread(cases, TrigramEncoder(), max_anchors=2).collect()}
    assert "max_anchors" in got["c"].error
    assert got["c"].floor is None
    assert got["d"].error is None
    with pytest.raises(Exception, match="max_anchors"):
        proofread(cases, TrigramEncoder(), max_anchors=2, strict=True).collect()


def test_unknown_locale_fails(spark):
    with pytest.raises(Exception, match="unknown locale"):
        one(spark, "x", "y", locale="xx")


def test_exact_word_note_and_receipts(spark):
    got = proofread(case_rows(spark, [("c", "rates of 4.75% for 45 days", [("policy.pdf#p3", "rates of 3.90% for 30 days")])], 2), TrigramEncoder())
    text = got.select(sinks.report(F.col("weakest")).alias("t")).first().t
    assert "nearest in policy.pdf#p3: '3.90%'" in text
    notes = {a.text: a.notes for a in got.first().anchors}
    assert notes["rates"] == ["exact_string_in_span"]
    row = got.select(sinks.receipt(F.struct(F.lit("w").alias("text"), F.lit(0.5).alias("support"), F.lit("").alias("evidence_id"), F.lit("it's").alias("evidence_text"), F.array(F.lit("exact_string_in_span")).alias("notes"))).alias("t")).first()
    assert row.t == "w" + " " * 13 + '  support 0.50   nearest in source: "it\'s"' + sinks.EXPLAIN


def test_sinks(spark):
    got = proofread(case_rows(spark, [("c", GOOD, SOURCE)]), TrigramEncoder())
    dump = json.loads(sinks.as_json(got).first().json)
    assert dump["anchors"][0]["kind"] == "skipped"
    assert dump["k"] == 1
    reply = json.loads(sinks.response(got).first().json)
    assert reply["weakest_anchors"][0]["checked_by"] in {"arithmetic", "meaning"}
    assert "not a verdict" in sinks.summary(got).first().text
    assert compact_json({"b": 5e-06, "a": "é"}) == '{"a":"é","b":5e-06}'


def test_one_case_alone_and_among_many(spark):
    alone = one(spark, GOOD, SOURCE)
    cases = case_rows(spark, [(i, GOOD if i == 500 else f"number {i}", SOURCE) for i in range(1000)]).repartition(7)
    many = proofread(cases, TrigramEncoder()).where("case_id = '500'").first()
    assert many.sha256 == alone.sha256
    assert exploded(proofread(cases, TrigramEncoder())).where("case_id = '500'").count() == len(alone.anchors)


def test_no_shuffle(spark):
    plan = proofread(case_rows(spark, [("c", GOOD, SOURCE)]), TrigramEncoder())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_sources(tmp_path, spark):
    assert [e.id for e in as_evidence(["a", ("x", "b"), Evidence("y", "c")])] == ["ctx-0", "x", "y"]
    for wrong in ([["x", "b"]], [{"id": 1}], [3]):
        with pytest.raises(TypeError, match=r"context\[0\]"):
            as_evidence(wrong)
    file = tmp_path / "s.txt"
    file.write_text("hello", encoding="utf-8")
    assert text_or_file(str(file)) == "hello"
    assert text_or_file("a=b") == "a=b"
    assert named_source(f"n={file}", 3) == ("n", "hello")
    assert named_source("a=b", 3) == ("ctx-3", "a=b")
