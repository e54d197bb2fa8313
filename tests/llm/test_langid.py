from __future__ import annotations

import itertools

import numpy as np
import pytest

from sourcemark.llm import langid as L
from sourcemark.llm.common import col, crc_mod
from sourcemark.llm.queries import PIECES

from .conftest import MESS


@pytest.fixture(scope="module")
def model(documents):
    return L.trained(documents.where(crc_mod(col("doc_id"), 4) != 2), PIECES)


def test_held_out_accuracy(documents, model):
    rows = L.identify(documents, model, crc_mod(col("doc_id"), 4) == 2).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert rows
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_forward_sums_all_segmentations():
    vocab = {p: i for i, p in enumerate(sorted(["▁a", "▁ab", "▁abc", "a", "b", "c", "ab", "bc"]))}
    pieces = L.Pieces(vocab)
    p = np.random.default_rng(1).random((len(vocab) + 2, 2))
    p[-1] = 0
    word = "abcab"
    total = np.zeros(2)
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [(L.MARK if a == 0 else "") + word[a:b] for a, b in zip(at, at[1:], strict=False)]
        if all(x in vocab for x in parts):
            total += np.prod([p[vocab[x]] for x in parts], 0)
    assert np.allclose(L.forward(L.lattice([word], pieces), p)[1][0], total)


def test_edges(docs_of, model):
    rows = L.identify(docs_of(MESS), model, crc_mod(col("doc_id"), 4) == 2).collect()
    assert len(rows) == len(MESS)
    by = {r.doc_id: r for r in rows}
    assert {by[i].lang_pred for i in (1, 2, 3, 4)} == {"und"}
    assert by[8].lang_pred in model.languages
    kept = L.keep_identified(docs_of(MESS), model, least=0.0)
    assert kept.columns == docs_of(MESS).columns
    assert {r.doc_id for r in kept.collect()} == {None, 5, 6, 7, 8}
    none = L.trained(docs_of([], lang=None), PIECES)
    assert {r.lang_pred for r in L.identify(docs_of(MESS), none, crc_mod(col("doc_id"), 4) == 2).collect()} == {"und"}
