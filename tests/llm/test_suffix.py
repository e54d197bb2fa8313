from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from sourcemark.llm import suffix as X

from .conftest import MESS


def plain(pairs, length):
    raws = [(t or "").encode() for _, t in pairs]
    seen = Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    out = Counter()
    for (i, _), b in zip(pairs, raws, strict=True):
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k + 1 : k + length + 1] = True
        kept = bytes(x for x, g in zip(b, gone[1:-1], strict=True) if not g)
        out[i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def got(docs, length):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in X.report(docs, length).collect())


def test_suffix_arrays_and_prefixes():
    rng = np.random.default_rng(2)
    for k in range(150):
        n, letters = int(rng.integers(1, 60)), int(rng.integers(2, 6))
        t = rng.integers(1, letters, n)
        t = np.append(np.tile(t[: max(1, n // 5)], 5) if k % 3 == 0 else t, 0).astype(np.int32)
        sa, text = X.suffix_array(t, letters), t.tolist()
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert sa.tolist() == want
        prefix, _ = X.common_prefixes(t, sa, 1)
        for i, j in zip(want[1:], want, strict=False):
            m = 0
            while max(i, j) + m < len(text) and text[i + m] == text[j + m]:
                m += 1
            assert prefix[i] == m


def test_least_in_windows():
    rng = np.random.default_rng(3)
    for n, size in ((50, 7), (100, 10), (37, 5), (9, 9)):
        x = rng.integers(0, 6, n).astype(np.uint64)
        assert X.least_in_windows(x, size).tolist() == [i + int(x[i : i + size].argmin()) for i in range(n - size + 1)]


def test_whole_table(documents):
    pairs = [(r.doc_id, r.text) for r in documents.where("doc_id < 1000").collect()]
    assert got(documents, 400) == plain(pairs, 400)


def test_recursion_through_many_levels():
    rng = np.random.default_rng(4)
    unit = rng.integers(1, 5, 40)
    t = np.concatenate([np.tile(unit, 400), rng.integers(1, 5, 3000), np.tile(unit, 200), np.ones(500, int), [0]]).astype(np.int32)
    raw = t.astype(np.uint8).tobytes()
    assert X.suffix_array(t, 5).tolist() == sorted(range(len(t)), key=lambda i: raw[i:])


@pytest.mark.parametrize(("most", "segment"), [(1000, 1 << 20), (1, 1 << 20), (1000, 50)])
def test_edges(docs_of, monkeypatch, most, segment):
    monkeypatch.setattr(X, "MOST", most)
    monkeypatch.setattr(X, "SEGMENT", segment)
    same = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(300))
    pairs = [*MESS, (20, same), (21, "é" * 10 + same), (22, same[100:250]), (23, same[:120] + "?" + same[121:]), (24, same + same), (25, "ab" * 200)]
    assert got(docs_of(pairs), 60) == plain(pairs, 60)
    assert got(docs_of([]), 60) == Counter()


def test_a_text_longer_than_a_segment_and_a_shard(docs_of):
    rng = np.random.default_rng(6)
    long = rng.integers(97, 123, 2_600_000).astype(np.uint8).tobytes().decode()
    pairs = [(1, long), (2, "x" + long[1_300_000:1_302_000] + "y"), (3, None), (4, long[:399])]
    rows = {r.doc_id: (r.n_removed, r.n_spans) for r in X.report(docs_of(pairs)).collect()}
    assert rows == {1: (2000, 1), 2: (2000, 1), 3: (0, 0), 4: (0, 0)}


def test_equal_windows_have_equal_keys(monkeypatch):
    rng = np.random.default_rng(7)
    letters = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes()
    shared = letters(200)
    raws = [letters(150) + shared + letters(90), b"", shared[40:170], letters(59), letters(30) + shared, letters(60), shared[:90] + letters(20) + shared, letters(500)]
    offs = np.cumsum([0, *map(len, raws)])
    for together, segment in ((1 << 15, 1 << 20), (600, 1 << 20), (1, 70)):
        monkeypatch.setattr(X, "TOGETHER", together)
        monkeypatch.setattr(X, "SEGMENT", segment)
        found, keys, seen = X.regions(np.frombuffer(b"".join(raws), np.uint8), offs, 60), {}, Counter()
        for row, p, lo, hi, h in zip(*(found[c].tolist() for c in ("row", "p", "lo", "hi", "h")), strict=True):
            for i in range(lo, hi - 59):
                seen[row, i] += 1
                assert keys.setdefault(raws[row][i : i + 60], (h, p - i)) == (h, p - i)
        assert seen == Counter({(k, i): 1 for k, x in enumerate(raws) for i in range(len(x) - 59)})


def test_shards_get_no_texts_that_share_too_little(docs_of, monkeypatch):
    rng = np.random.default_rng(8)
    letters = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    phrase, dealt, by_shards = letters(200), [], X._by_shards
    monkeypatch.setattr(X, "_by_shards", lambda found, length: (dealt.append(found.count()), by_shards(found, length))[1])
    pairs = [(i, letters(600) + phrase + letters(600)) for i in range(20)]
    assert got(docs_of(pairs), 400) == plain(pairs, 400)
    assert dealt == [0]
