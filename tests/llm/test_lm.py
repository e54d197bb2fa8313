from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sourcemark.llm import lm
from sourcemark.llm.common import col, crc_mod

from .conftest import MESS


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 5 == 1


def score(docs):
    return lm.scored(docs, crc_mod(col("doc_id"), 5) == 1).collect()


def hold(rows, pairs):
    c = Counter(t for i, x in pairs if not held(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(t), sum(c[x] > 0 for x in t), round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), 5)) for i, t in ((i, tokens(x)) for i, x in pairs))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in rows) == want
    assert {r.train_tokens for r in rows} == {n}


def test_base_and_counts(docs_of):
    hold(score(docs_of(MESS)), MESS)
    assert score(docs_of([])) == []


def test_model_beats_the_base_on_held_out_texts(documents):
    rows = score(documents)
    hold(rows, [(r.doc_id, r.text) for r in documents.collect()])
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) * 0.95
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert all(r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in rows)


def test_probabilities_of_texts_add_up_to_less_than_one(docs_of):
    """All texts of up to two words, over the known words and one unknown, leave something for the longer ones."""
    train = [(i, f"a {'b' if i % 3 else 'c'} d {'a' if i % 2 else 'b'}") for i in range(60) if not held(i)]
    words = ["a", "b", "c", "d", "zz"]
    texts = ["", *words, *(f"{u} {w}" for u in words for w in words)]
    asked = list(zip((i for i in range(500, 2000) if held(i)), texts, strict=False))
    total = sum(10**r.score for r in score(docs_of(train + asked)) if r.held_out)
    assert 0.001 < total < 1


def exact_tables(c, weight, d):
    """P(tables) of a dish with c customers: weight ** t times generalised Stirling numbers."""
    log = np.full(c + 2, -np.inf)
    log[1] = 0
    for n in range(1, c):
        with np.errstate(divide="ignore"):
            log = np.logaddexp(np.append(-np.inf, log[:-1]), log + np.log(np.maximum(n - d * np.arange(len(log)), 0)))
    log += np.arange(len(log)) * math.log(weight)
    p = np.exp(log - log.max())
    return p / p.sum()


@pytest.mark.parametrize(("c", "weight"), [(2, 0.3), (2, 40.0), (3, 1.0), (7, 5.0), (7, 300.0), (40, 0.01), (40, 20.0), (600, 0.5), (600, 12.0)])
@pytest.mark.parametrize("d", [0.8, 0.6])
def test_seating_is_the_conditional_of_the_restaurant(c, weight, d):
    rng, n = np.random.default_rng(1), 4000
    t, r = np.ones(n), np.full(n, float(c))
    for _ in range(12):
        t, r = lm.reseated(np.full(n, c), np.full(n, weight), t, r, d, rng)
    want = exact_tables(c, weight, d)
    assert t.mean() == pytest.approx((want * np.arange(len(want))).sum(), rel=0.03)
    got = np.bincount(t.astype(int), minlength=len(want))[: len(want)] / n
    assert np.abs(np.cumsum(got) - np.cumsum(want)).max() < 0.04
    assert ((t == 1) == (r == c)).all()


def by_customers(train, texts, sweeps, rng):
    """log10 scores by a sampler that seats one customer after another, all in one process."""
    (d1, s1), (d0, s0) = lm.LEAF, lm.ROOT
    words = {t for x in train for t in tokens(x)}
    pairs = Counter((a, b) for x in train for a, b in zip([None, *tokens(x)], tokens(x), strict=False))
    known = len(words)
    leaf, root = {}, {w: [] for w in words}  # sizes of tables

    def draw(sizes, weight, d):
        p = np.array([max(0, x - d) for x in sizes] + [weight])
        return int(rng.choice(len(p), p=p / p.sum()))

    def weights():
        seats, customers = sum(len(x) for x in root.values()), sum(sum(x) for x in root.values())
        base = (s0 + d0 * seats) / (known + 1)
        return base, {w: (sum(x) - d0 * len(x) + base) / (s0 + customers) for w, x in root.items()}, (base / (s0 + customers))

    def join(sizes, weight, d):
        k = draw(sizes, weight, d)
        if k == len(sizes):
            sizes.append(1)
            return True
        sizes[k] += 1
        return False

    def leave(sizes):
        k = int(rng.choice(len(sizes), p=np.array(sizes) / sum(sizes)))
        sizes[k] -= 1
        if not sizes[k]:
            del sizes[k]
            return True
        return False

    out, used = [np.zeros(len(tokens(x))) for x in texts], 0
    for sweep in range(sweeps):
        for (u, v), c in pairs.items():
            sizes = leaf.setdefault((u, v), [])
            for _ in range(c):
                if sweep and leave(sizes):
                    leave(root[v])
                base, p, _ = weights()
                context = sum(len(x) for (a, _), x in leaf.items() if a == u)
                if join(sizes, (s1 + d1 * context) * p[v], d1):
                    join(root[v], base, d0)
        if sweep >= 2:
            used += 1
            _, p, other = weights()
            c = Counter(u for (u, _), n in pairs.items() for _ in range(n))
            tables = Counter(u for (u, _), x in leaf.items() for _ in x)
            for x, sums in zip(texts, out, strict=True):
                sums += [(max(0, pairs[a, b] - d1 * len(leaf.get((a, b), []))) + (s1 + d1 * tables[a]) * p.get(b, other)) / (s1 + c[a]) if c[a] else p.get(b, other) for a, b in zip([None, *tokens(x)], tokens(x), strict=False)]
    return np.array([np.log10(x / used).sum() for x in out])


def test_scores_are_those_of_seating_one_by_one(docs_of):
    rng = np.random.default_rng(5)
    word = [f"w{i}" for i in range(12)]
    texts = [" ".join(word[min(11, int(rng.exponential(2.5)))] for _ in range(8)) for _ in range(40)] + ["w0 w0 w0 w0 w1 w0 w0", "w11 never w3"]
    pairs = list(enumerate(texts))
    # as many sweeps on either side as make chance small
    rows = lm.scored(docs_of(pairs), crc_mod(col("doc_id"), 5) == 1, sweeps=20).collect()
    got = {r.doc_id: r.score for r in rows}
    want = by_customers([t for i, t in pairs if not held(i)], texts, 40, rng)
    have = np.array([got[i] for i, _ in pairs])
    assert have.sum() == pytest.approx(want.sum(), rel=0.02)
    assert np.abs(have - want).max() < 0.5


def test_many_shards_give_about_the_same_scores(documents, monkeypatch):
    one = {r.doc_id: r.score for r in score(documents)}
    monkeypatch.setattr(lm.coded, "__defaults__", (50_000,))
    named = documents.selectExpr("doc_id", "doc_id % 5 = 1 AS held_out", "text")
    assert lm.coded(named).count() > 3
    rows = score(documents)
    hold(rows, [(r.doc_id, r.text) for r in documents.collect()])
    assert sum(r.score for r in rows) == pytest.approx(sum(one.values()), rel=0.01)
