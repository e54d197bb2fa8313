from __future__ import annotations

import json

from pyspark.sql import functions as F

from sourcemark.functions import columns as C
from sourcemark.functions.encoders import window_bounds
from sourcemark.operators.windows import windows
from sourcemark.sources import sinks
from sourcemark.streaming.stream import proofread_stream, read_cases


def test_native_normal_form_equals_the_plain_one(spark):
    from sourcemark.functions.scan import normalised

    texts = [" a\r\nb\rc\n\n\n\nd\t\v e ​f\n", "ﬁ ² １２", "　x ", "", None, "\x1cq\x85"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(C.normalised(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [None if t is None else normalised(t) for t in texts]


def test_windows_as_rows(spark):
    sized = spark.createDataFrame([(n,) for n in range(60)], "n_tokens int")
    for limit in (1, 2, 5, 16):
        got: dict[int, list] = {}
        for r in windows(sized, limit).orderBy("n_tokens", "first_token").collect():
            got.setdefault(r.n_tokens, []).append((r.first_token, r.last_token))
        assert got == {n: window_bounds(n, limit) for n in range(1, 60)}


def test_functions_in_sql(spark):
    C.register(spark)
    row = spark.sql("SELECT numerals('due 10,000', 'en') AS n, units('due 10,000', 'en') AS u").first()
    assert row.n[0].readings == ["10000"]
    assert [u.kind for u in row.u] == ["lexical", "numeral"]


def test_structural_dump(spark):
    found = spark.createDataFrame([("en", "of 10,000")], "locale string, text string").withColumn("units", C.units("text", "locale"))
    dump = json.loads(sinks.structural_dump(found).first().json)
    assert dump["units"] == [{"kind": "skipped", "notes": ["stopword"], "readings": None, "span": [0, 2], "text": "of"}, {"kind": "numeral", "notes": [], "readings": ["10000"], "span": [3, 9], "text": "10,000"}]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    case = {"case_id": "1", "answer": "due 1,000", "sources": [{"id": "", "text": "due 10,000"}], "k": 1, "locale": "en"}
    (tmp_path / "in/a.json").write_text(json.dumps(case))
    stream = proofread_stream(read_cases(spark, str(tmp_path / "in")), None, str(tmp_path / "out"), str(tmp_path / "check"), availableNow=True)
    stream.awaitTermination()
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert row.floor == 0
    assert row.anchors[1].evidence_id == "ctx-0"
