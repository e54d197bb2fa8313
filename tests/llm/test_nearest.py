from __future__ import annotations

import numpy as np
import pytest

from sourcemark.llm import nearest as N


def exact(ids, x, k, every):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            s = (x * q).sum(1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


def found(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in want.items()])


def test_recall_on_the_table(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    both = rows.orderBy("vec_id").collect()
    want = exact(np.array([r.vec_id for r in both]), np.array([r.embedding for r in both], float), 20, 20)
    got = found(N.search(rows))
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.9
    for q, w in got.items():
        assert [s for _, s in w] == sorted((s for _, s in w), reverse=True)
        known = dict(want[q])
        assert all(abs(known[i] - s) < 1e-12 for i, s in w if i in known)


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_lengths_ties_and_blocks(spark, monkeypatch, spread):
    monkeypatch.setattr(N, "CELL", 7)
    monkeypatch.setattr(N, "FEW", 50)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 10)) * (1 + spread * rng.random((300, 1)))
    x[100:200] = x[100]  # a hot vector
    rows = spark.createDataFrame([(i, [float(v) for v in r], 3.0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, score double")
    got, want = found(N.search(rows, k=5, every=10, share=1.0)), exact(np.arange(300), x, 5, 10)
    assert recall(got, want) >= 0.9
    hot = [i for i, _ in got[100] if 100 < i < 200]
    assert hot == list(range(101, 101 + len(hot)))
    assert hot


def table_of(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("factor", [10, 100])
def test_one_large_norm_leaves_the_others_found(spark, factor):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 64))[rng.integers(0, 60, 3000)] + 0.5 * rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[3] *= factor
    got, want = found(N.search(table_of(spark, x))), exact(np.arange(3000), x, 20, 20)
    assert recall(got, want) >= 0.95
    assert all(len(got[q]) == 20 for q in want)


@pytest.mark.parametrize("few", [1000, 0])
def test_small_tables_give_all_candidates(spark, monkeypatch, few):
    monkeypatch.setattr(N, "FEW", few)
    x = np.random.default_rng(2).normal(size=(10, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = found(N.search(table_of(spark, x), every=5))
    assert {q: sorted(i for i, _ in w) for q, w in got.items()} == {q: sorted({*range(10)} - {q}) for q in (0, 5)}


def test_probes_are_the_nearest_combinations():
    rng = np.random.default_rng(1)
    h = N.Hashes(16, {0: N.Range(1.0, 9000)}, tables=2)
    x = rng.normal(size=(5, 16))
    got, n = h.probed(x, 0), N.probes(9000, 2)
    for t in range(2):
        ys = h.turned(h.lift(x), t, N.bits_for(9000))
        assert len(ys) == 3
        for i in range(5):
            each = [(y[i].max() - y[i]) ** 2 for y in ys]
            cost = (each[0][:, None, None] + each[1][:, None] + each[2]).ravel()
            assert sorted(cost[got[i, t]]) == pytest.approx(sorted(cost)[:n])
    # the bucket of a vector is its own first probe
    assert all((h.codes(x, 0)[:, t, None] == got[:, t]).any(1).all() for t in range(2))


def shares(x, asked):
    """Share of the rows that become candidates, and recall, of the hashing alone."""
    h = N.Hashes(x.shape[1], {0: N.Range(1.0, len(x))})
    code, probe = h.codes(x, 0), h.probed(x[asked], 0)
    got = np.zeros((len(asked), len(x)), bool)
    for t in range(h.tables):
        hit = np.zeros((len(asked), 1 << N.bits_for(len(x))), bool)
        np.put_along_axis(hit, probe[:, t], True, 1)
        got |= hit[:, code[:, t]]
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -2
    near = np.argpartition(-s, 20, 1)[:, :20]
    return got.mean(), np.take_along_axis(got, near, 1).mean()


def test_recall_and_candidate_share_at_two_sizes():
    """Random vectors, the hardest case: the share falls as rows grow, recall stays."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(50_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    few, many = shares(x[:5000], np.arange(100)), shares(x, np.arange(100))
    assert few[1] >= 0.9
    assert many[1] >= 0.9
    assert many[0] < 0.17 < few[0] < 0.4


def test_many_rows_of_one_vector(spark, monkeypatch):
    monkeypatch.setattr(N, "FEW", 50)
    monkeypatch.setattr(N, "CELL", 40)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 16))
    x[300:700] = x[5]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got, want = found(N.search(table_of(spark, x), k=5, every=10, share=2.0)), exact(np.arange(900), x, 5, 10)
    assert recall(got, want) >= 0.9
    assert [i for i, _ in got[400]] == [5, 300, 301, 302, 303]


def test_edges(spark):
    bad = [(0, None), (20, []), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (None, [1.0, 1.0]), (120, [1.0, 2.0]), (140, [1.0, 2.0, 3.0]), (1, [3.0, 4.0]), (1, [3.0, 4.0])]
    got = found(N.search(spark.createDataFrame(bad, "vec_id long, embedding array<float>")))
    assert got == {120: [(1, 11.0)]}
    assert N.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
