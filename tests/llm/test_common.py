from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sourcemark.llm import common as C


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \t\né漢X", max_size=30)), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    w = C.Words(*C.utf8(pa.array(texts, pa.string())))
    got = [[w.text(i) for i in range(a, b)] for a, b in zip(w.first, w.first[1:], strict=False)]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    by = {}
    for i in range(len(w.start)):
        by.setdefault(re.sub("[A-Z]", lambda m: m[0].lower(), w.text(i)), set()).add(int(w.hash[i]))
    assert all(len(x) == 1 for x in by.values())
    assert len(set().union(*by.values())) == len(by)


def test_words_across_chunks(monkeypatch):
    whole = C.Words(*C.utf8(pa.array(["one two three four", "five six"])))
    monkeypatch.setattr(C, "CHUNK_BYTES", 4)
    cut = C.Words(*C.utf8(pa.array(["one two three four", "five six"])))
    assert (whole.hash == cut.hash).all()


def test_chunks_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (1, 500, 3, 0, 900)])], names=["text"])
    parts = list(C.chunks([batch, batch.slice(2)], limit=400))
    assert [t for p in parts for t in p.column("text").to_pylist()] == [*batch.column("text").to_pylist(), *batch.slice(2).column("text").to_pylist()]


def test_whole_runs():
    keys = np.sort(np.random.default_rng(1).integers(0, 30, 500))
    batches = pa.Table.from_pydict({"k": keys}).to_batches(max_chunksize=7)
    got = [(held.column("k")[int(i)].as_py(), int(j - i)) for held, cut in C.whole_runs(batches, ["k"]) for i, j in zip(cut, cut[1:], strict=False)]
    values, counts = np.unique(keys, return_counts=True)
    assert got == list(zip(values.tolist(), counts.tolist(), strict=True))


def test_code_points():
    assert C.code_points(np.frombuffer("aé漢😀b".encode(), np.uint8)).tolist()[-1] == 5
