from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sourcemark.llm import neardup as N

from .conftest import MESS


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return ({tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}) if words else set()


def plain(pairs, percent):
    """Components by comparing all pairs."""
    s = [(i, sets(t)) for i, t in pairs if i is not None]
    at = {i: i for i, _ in s}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for k, (i, x) in enumerate(s):
        for j, y in s[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    return {i: root(i) for i in at}


def hold(docs, pairs, percent):
    want, n = plain(pairs, percent), {}
    for i, t in pairs:
        n.setdefault(i, set()).add(len(sets(t)))
    rows = N.groups(docs, percent).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        assert r.n_shingles in n[r.doc_id]
        assert r.component_id == want.get(r.doc_id)
        assert r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize("percent", [80, 85])
def test_whole_table(documents, percent):
    hold(documents, [(r.doc_id, r.text) for r in documents.collect()], percent)


@pytest.mark.parametrize("block", [2048, 3])
def test_families_and_edges(docs_of, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "PART", 4)
    draw = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [draw.choice(words) for _ in range(120)]
    family = []
    for i in range(30):
        text = list(base)
        for _ in range(i % 5):
            text[draw.randrange(120)] = draw.choice(words)
        family.append((100 + i, " ".join(text).upper() if i % 4 == 0 else " ".join(text)))
    shared = " ".join(base[:40])
    apart = [(200 + i, shared + " " + " ".join(draw.choice(words) for _ in range(90))) for i in range(25)]
    pairs = MESS + family + apart + [(300, family[0][1]), (301, family[0][1])]
    hold(docs_of(pairs), pairs, 85)


def test_one_each_keeps_columns(docs_of):
    text = " ".join(f"w{i}" for i in range(50))
    pairs = [*MESS, (40, text), (41, text), (42, text + " x")]
    kept = N.one_each(docs_of(pairs))
    assert kept.columns == docs_of(pairs).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 4, 5, 5, 6, 7, 8, 40]
    assert N.groups(docs_of([])).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 2000).astype(np.uint64)
    for share in (0.5, 0.85):
        same = int(2000 * 2 * share / (1 + share))
        y = np.concatenate([x[:same], rng.integers(0, 2**63, 2000 - same).astype(np.uint64)])
        a, b = (N.signature(np.unique(z)) for z in (x, y))
        assert abs((a == b).mean() - share) < 0.12
    assert 80 < N.matches_needed(85) < 100


@pytest.mark.parametrize("percent", [80, 85])
def test_prefixes_meet(spark, percent):
    """Any two signatures that collide often enough share a posted pair, whatever the counts are; frequent pairs are posted last."""
    rng, need = np.random.default_rng(3), N.matches_needed(percent)
    base = rng.integers(0, 2**32, N.COORDS, dtype=np.uint32)
    rows = []
    for i in range(60):
        own = rng.integers(0, 2**32, N.COORDS, dtype=np.uint32)
        own[rng.permutation(N.COORDS)[: need + i % 20]] = 0
        rows.append((i, i, i, 9, bytearray(np.where(own, own, base).astype(np.uint32).tobytes())))
    classes = spark.createDataFrame(rows, "k1 long, k2 long, doc_id long, n_shingles long, minima binary")
    rank = N.ranks(classes)
    assert len(rank) == N.SLOTS and rank.max() in (6, 7)
    for order in (rank, rng.integers(0, 9, N.SLOTS).astype(np.uint8)):
        got = N.prefixes(classes, order, N.prefix_length(need)).collect()
        values = [np.frombuffer(r[4], np.uint32) for r in rows]
        for a in range(60):
            for b in range(a):
                if (values[a] == values[b]).sum() >= need:
                    assert set(got[a]["keys"]) & set(got[b]["keys"])
    rare = N.coordinate_values(pa.array([bytes(r[4]) for r in rows], pa.binary()))[1].view(np.int64)
    got = N.prefixes(classes, rank, N.COORDS - need - 19).collect()
    assert not any(set(r["keys"]) & set(rare[i][values[i] == base].tolist()) for i, r in enumerate(got))


def test_shingles():
    got = N.shingle_sets(pa.array(["a b c d e f", "A b C d e", "a b", None, "a a a a a a a a"]))
    assert [len(s) for s in got] == [2, 1, 1, 0, 1]
    assert got[1][0] in got[0]
