from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sourcemark.llm import secrets as S

from .conftest import MESS


def by_patterns(text):
    """The contract's patterns as they stand."""
    assign = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "ſecret", "toKen", "api_key", " ", ":", "=", "'", "abcdefgh1", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "é", "x"]), max_size=14).map("".join))
def test_base_spans(text):
    assert S.base_spans(text) == by_patterns(text)


def test_report_over_the_table(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = S.report(documents, S.trained(documents)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = by_patterns(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert {f"{S.KINDS[k]}:{s}:{f}" for s, k, f in base} <= set(r.spans.split(","))
    extra = sum(x.startswith("crf") for r in rows for x in r.spans.split(","))
    assert extra <= len(rows) // 20


def test_viterbi_is_best_of_all_paths():
    rng = np.random.default_rng(1)
    step = rng.normal(size=(3, 3))
    step[S.OUT, S.IN] = -20
    sizes = [5, 1, 4, 6]
    begins = np.cumsum([0, *sizes[:-1]])
    e = rng.normal(size=(sum(sizes), 3))
    got = S.decode(e, begins, step)
    for a, n in zip(begins, sizes, strict=True):
        best = max(itertools.product(range(3), repeat=n), key=lambda p: sum(e[a + i, t] for i, t in enumerate(p)) - 20 * (p[0] == S.IN) + sum(step[x, y] for x, y in zip(p, p[1:], strict=False)))
        assert tuple(got[a : a + n]) == best


@pytest.mark.parametrize("line", [1, 3, 7])
def test_long_lines_are_decoded_whole(monkeypatch, line):
    rng = np.random.default_rng(4)
    step, e = rng.normal(size=(3, 3)), rng.normal(size=(200, 3)) * 2
    step[S.OUT, S.IN] = -20
    begins = np.array([0, 1, 5, 60, 67, 190])
    want = S.decode(e, begins, step)
    monkeypatch.setattr(S, "LINE", line)
    assert S.decode(e, begins, step).tolist() == want.tolist()


@pytest.fixture(scope="module")
def settings_files(docs_of):
    rows = []
    for i in range(60):
        key = "".join("abcdef0123456789"[(i * 7 + j * j) % 16] for j in range(40))
        rows.append((i, f"# settings\nhost = web{i}\ntoken = {key}\nmode = fast and quiet\n"))
        rows.append((1000 + i, f"The quick brown fox number {i} jumps over the lazy dog and sleeps."))
    return rows


def test_the_field_finds_what_no_pattern_does(docs_of, settings_files):
    field = S.trained(docs_of(settings_files))
    assert field.learnt
    odd = [(9, "# settings\nhost = web1\nauthorisation = 9c3fe1a27b64d0581e2f7a90bb31c4d7\nmode = fast\n"), (10, "# settings\nhost = a\ntoken  {9c3fe1a27b64d0581e2f7a90bb31\nmode = fast\n"), (11, "The fox sleeps.")]
    rows = {r.doc_id: r for r in S.report(docs_of(odd), field).collect()}
    assert "crf" in rows[10].spans
    assert "hex" in rows[9].spans
    assert rows[11].spans == ""


def test_secrets_anywhere_in_lines_and_runs(docs_of, settings_files):
    field = S.trained(docs_of(settings_files))
    held = "9c3fe1a27b64d0581e2f7a90bb31"
    odd = [(i, f"{'host = a ' * i}token  {{{held}\n") for i in (84, 85, 86, 170)]  # at, before and behind a block's end
    run = "".join(f'"host{i}":"web",' for i in range(40))
    odd.append((1, f'{{{run}"token":{{"{held}"}}}}'))
    for r in S.report(docs_of(odd), field).collect():
        text = dict(odd)[r.doc_id]
        spans = [x.split(":") for x in r.spans.split(",") if x.startswith("crf")]
        assert any(held in text[int(a) : int(b)] and int(b) - int(a) <= 40 for _, a, b in spans), (r.doc_id, r.spans)


def planted(draw, documents):
    """Prose of the table with one secret in each text: an assignment of mixed letters and digits, an access key or a long hex run."""
    letters, upper, hexes = "abcdefghjkmnpqrstuvwxyzABCDEFGHJKLMNP23456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef"
    rows = []
    for n, r in enumerate(documents.orderBy("doc_id").limit(360).collect()):
        words = [w for w in (r.text or "").split(" ") if not S.base_spans(w) and not re.search("[0-9]", w)][:80]
        kind = n % 3
        value = "".join(draw.choice((letters, upper, hexes)[kind]) for _ in range((24, 28, 40)[kind]))
        form = (f'password = "{value}"', f'access_id = "AKIA{value}"', f'checksum_key = "{value}"')[kind]
        at = draw.randrange(len(words) + 1)
        rows.append((n, " ".join([*words[:at], form, *words[at:]])))
    return rows


@pytest.mark.parametrize("left_out", [0, 1, 2])
def test_secrets_of_a_kind_that_was_not_taught(docs_of, documents, left_out):
    """The field is fitted without one kind's pattern and finds that kind by what is like the others'."""
    draw = random.Random(left_out)
    rows = planted(draw, documents)
    field = S.trained(docs_of(rows), kinds=tuple({0, 1, 2} - {left_out}))
    texts, found, right, extra = dict(rows), 0, 0, 0
    patterns = S.base_spans
    try:
        S.base_spans = lambda text, hexes=True: [x for x in patterns(text, hexes) if x[1] != left_out]
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
        for some, _, spans in S._found([batch], field):
            for i, each in zip(some.column("doc_id").to_pylist(), spans, strict=True):
                masked = [x for x in patterns(texts[i]) if x[1] == left_out]
                crf = [x for x in each if x[1] == S.CRF]
                found += len(masked)
                right += sum(any(s < y and x < f for x, _, y in crf) for s, _, f in masked)
                extra += sum(not any(s < y and x < f for s, _, f in patterns(texts[i])) for x, _, y in crf)
    finally:
        S.base_spans = patterns
    print("kind", left_out, "masked", found, "found", right, "others marked", extra)
    assert found >= 60
    assert right >= 0.8 * found
    assert extra <= 0.05 * len(rows)


def test_edges(docs_of):
    field = S.trained(docs_of(MESS))
    assert not field.learnt
    assert len(S.report(docs_of(MESS), field).collect()) == len(MESS)
    assert S.report(docs_of([]), S.trained(docs_of([]))).count() == 0
