from __future__ import annotations

import numpy as np
import pytest

from sourcemark.functions.encoders import Encoder, ModelEncoder, TrigramEncoder, embed, host_array, plan_windows, scorable, unit_rows, window_bounds
from sourcemark.operators.anchors import anchors_of


@pytest.mark.parametrize("limit", [1, 2, 4, 7, 16])
@pytest.mark.parametrize("n", [0, 1, 5, 16, 33])
def test_windows_cover_all_tokens(limit, n):
    seen = {i for a, b in window_bounds(n, limit) for i in range(a, b)}
    assert seen == set(range(n))
    assert all(b - a <= limit for a, b in window_bounds(n, limit))


def test_windows_cut_at_tokens():
    e = TrigramEncoder(4)
    text = "alpha beta gamma delta epsilon"
    for w in plan_windows(text, e):
        assert text[w.offset : w.offset + len(w.text)] == w.text
        assert len(e.token_spans(w.text)) == w.last_token - w.first_token
    assert len(plan_windows("alpha", e)) == 1
    assert plan_windows("", e) == []


def test_encoders_satisfy_the_interface():
    assert isinstance(TrigramEncoder(), Encoder)
    assert hasattr(ModelEncoder, "encode_window")
    with pytest.raises(ValueError, match="max_tokens"):
        TrigramEncoder(2).encode_window("one two three four")


def test_spans_and_vectors_must_agree():
    class Broken(TrigramEncoder):
        def encode_window(self, text):
            got = super().encode_window(text)
            return got._replace(vectors=got.vectors[:-1])

    with pytest.raises(ValueError, match="spans"):
        embed("one two", Broken())


def test_host_arrays_and_unit_rows():
    class Tensor:
        def detach(self):
            return self

        def cpu(self):
            return [[3.0, 4.0]]

    assert np.allclose(unit_rows(host_array(Tensor().detach().cpu())), [[0.6, 0.8]])
    assert host_array([[1, 2]]).dtype == np.float32


def test_punctuation_is_evidence_only_if_there_is_nothing_else():
    assert scorable("a .", embed("a .", TrigramEncoder())) == [0]
    assert scorable(". !", embed(". !", TrigramEncoder())) == [0, 1]


@pytest.mark.parametrize("limit", [2, 3, 8, 16, 64])
def test_no_word_is_lost_at_any_window(limit):
    text = " ".join(f"alpha{chr(97 + i % 26)} 1{i:03d}" for i in range(60))
    got = anchors_of(text, [("s", text)], "und", TrigramEncoder(limit), 2048)
    assert len(got) == 120
    assert all(a["support"] == pytest.approx(1) for a in got)


def test_too_many_words_and_unaligned_words_are_errors():
    with pytest.raises(ValueError, match="max_anchors"):
        anchors_of("one two three", [], "und", TrigramEncoder(), 2)

    class Blind(TrigramEncoder):
        def token_spans(self, text):
            return ()

    with pytest.raises(ValueError, match="meets no token"):
        anchors_of("word", [("s", "word")], "und", Blind(), 10)
