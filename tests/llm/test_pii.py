from __future__ import annotations

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sourcemark.llm import pii as P

from .conftest import MESS


def by_patterns(text):
    """The contract's patterns as they stand."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and P.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


SAMPLES = ["a.b@c.d.e x@y @z.w", "q@r@s.t", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 007.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (499) 555-6503%%% +12 3", "é@b.c x@é.fr ü+1 23 456 7890 ", "a@b.c.d@e.f"]


@pytest.mark.parametrize("text", SAMPLES)
def test_base_spans(text):
    assert P.base_spans(text) == by_patterns(text)


@settings(max_examples=400, deadline=None)
@given(st.text("ab@.+-( )0149é", max_size=60))
def test_base_spans_of_any_text(text):
    assert P.base_spans(text) == by_patterns(text)


def test_long_runs_are_quick():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 100_000, "+1" * 50_000):
        P.base_spans(text)


def test_report_over_the_table(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = P.report(documents).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = by_patterns(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(",".join(f"{P.KINDS[k]}:{s}:{f}" for s, k, f in base).split(",")) - {""} <= set(r.spans.split(","))


def test_terms_that_disclose(docs_of):
    secret = [(i, f"letter {i} from Zorbaline Quux to bob@corp.example about lunch number {'abcdefgh'[i]}") for i in range(8)]
    clean = [(100 + i, f"a letter about lunch from someone to somebody {i} number") for i in range(40)]
    rows = {r.doc_id: r for r in P.report(docs_of(secret + clean)).collect()}
    text = secret[0][1]
    terms = {text[int(a) : int(b)] for k, a, b in (x.split(":") for x in rows[0].spans.split(",")) if k == "term"}
    assert "Zorbaline" in terms
    assert not terms & {"letter", "about", "lunch", "from", "number"}
    assert all(rows[i].spans == "" for i, _ in clean)
    out = {r.doc_id: r for r in P.redact(docs_of(secret + clean)).collect()}
    assert "bob@" not in out[0].text
    assert "[EMAIL]" in out[0].text
    assert "Zorbaline" not in out[0].text
    assert out[0].n_chars == len(out[0].text)
    assert [out[i].text for i, _ in clean] == [t for _, t in clean]


def test_an_entity_of_one_document_has_terms(docs_of):
    docs = [(0, "a letter about lunch from Zorbaline to bob@corp.example"), *((1 + i, "a letter about lunch from someone") for i in range(40))]
    rows = {r.doc_id: r.spans for r in P.report(docs_of(docs)).collect()}
    at = docs[0][1].index("Zorbaline")
    assert f"term:{at}:{at + 9}" in rows[0].split(",")
    assert rows[0].count("term") == 1


def test_terms_stand_on_the_table(documents):
    assert any("term" in r.spans for r in P.report(documents).collect())


def by_counting(texts):
    """Term spans of texts whose words are parted by single spaces, by counting documents."""
    held = [{P.entity(x, s) for s in P.base_spans(x)} for x in texts]
    words = [{v.lower() for v in re.findall("[a-zA-Z]+", x) if len(v) >= P.SHORTEST} for x in texts]
    n, out = len(texts), []
    for x, entities, terms in zip(texts, held, words, strict=True):
        marked = set()
        for e in entities:
            n_e = sum(e in h for h in held)
            for t in terms:
                joint, n_t = sum(e in h and t in w for h, w in zip(held, words, strict=True)), sum(t in w for w in words)
                if n_e < n and math.log(joint * n / (n_e * n_t)) / math.log(n / n_e) >= P.GENERALISE:
                    marked.add(t)
        base = P.base_spans(x)
        out.append(sorted((m.start(), m.end()) for m in re.finditer("[a-zA-Z]+", x) if m[0].lower() in marked and all(m.end() <= s or m.start() >= f for s, _, f in base)))
    return out


def test_terms_are_counted_and_marked_throughout_documents(docs_of):
    far = " ".join(["and so on"] * 5)
    texts = [f"write to bob@corp.example {far} yours Zorbaline" + (" or Zorbaline again" if i == 3 else "") for i in range(6)]
    texts += [f"call +1 499 555 650{i} {far} {name} and corp" for i, name in enumerate(["Quux", "Wibble", "Quux"])]
    texts += [f"{far} write yours again or call {i}" for i in range(60)]
    want = by_counting(texts)
    rows = {r.doc_id: r for r in P.report(docs_of(list(enumerate(texts)))).collect()}
    got = [sorted((int(s), int(f)) for k, s, f in (x.split(":") for x in rows[i].spans.split(",") if x) if k == "term") for i in range(len(texts))]
    assert got == want
    assert [texts[3][s:f] for s, f in got[3]].count("Zorbaline") == 2
    assert "Wibble" in [texts[7][s:f] for s, f in got[7]]


def test_edges(docs_of):
    assert len(P.report(docs_of(MESS)).collect()) == len(MESS)
    out = P.redact(docs_of(MESS))
    assert out.columns == docs_of(MESS).columns
    assert sorted((r.doc_id or -1, r.text or "") for r in out.collect()) == sorted((i or -1, t or "") for i, t in MESS)
    assert P.report(docs_of([])).count() == P.redact(docs_of([])).count() == 0
