from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sourcemark.llm import packing as P
from sourcemark.llm.queries import BYTE_BPE

from .conftest import MESS


def plain(texts):
    t = Tokenizer.from_file(BYTE_BPE)
    return [np.array([*e.ids, P.END], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def hold(rows, pairs):
    ids = defaultdict(list)
    for (i, _), x in zip(pairs, plain([t for _, t in pairs]), strict=True):
        ids[i].append(x)
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 1 <= r.length <= P.SIZE
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    for i, xs in ids.items():
        assert sum(r.length for r in pieces[i]) == sum(map(len, xs))
        if len(xs) == 1:
            ps = sorted(pieces[i], key=lambda r: r.piece)
            assert [r.piece for r in ps] == list(range(len(ps)))
            assert all(r.length == P.SIZE for r in ps[1:])
            assert [r.start for r in ps] == [0, *np.cumsum([r.length for r in ps])[:-1]]
    for at in places.values():
        at.sort()
        assert [o for o, _ in at] == [0, *np.cumsum([n for _, n in at])[:-1]]
        assert sum(n for _, n in at) <= P.SIZE
    return len(places)


def test_ids_are_the_tokenizer_s():
    draw = random.Random(3)
    odd = "abé1'.,!?\t\n   　 éé日᠎\x1c\x85-"
    odd = [*odd, "<|endoftext|>", "<|endof", " the", "'s"]
    texts = ["", "it's don't I'll we've é's", "<|endoftext|> x", "hello <|endoftext|> world", "x <|endoftext|>  y<|endoftext|><|endoftext|>", "<|endof", "text|>", "\n\n x\n y", ". ,", "a.,b", "über.Öl,×a÷b. Ω.x"]
    texts += ["".join(draw.choice(odd) for _ in range(draw.randint(1, 40))) for _ in range(2000)]
    for limit in (300_000, 10):
        own = P.Encoder(BYTE_BPE, limit)
        for at in range(0, len(texts), 500):
            ids, begin = own.ids(pa.array(texts[at : at + 500]), P.END)
            assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)] == [x.tolist() for x in plain(texts[at : at + 500])]


def test_a_very_long_text():
    text = "A word, then the next.\n" * 120_000 + "<|endoftext|>" + "x" * 5000
    ids, begin = P.Encoder(BYTE_BPE).ids(pa.array([None, text, "a"]), P.END)
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)] == [x.tolist() for x in plain(["", text, "a"])]


def test_best_two_fit():
    # greedy takes 6 and 3; two of 2 fill the gap of 4 that 3 would leave
    bins = P.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert sorted(map(sorted, bins)) == [[0, 2, 3], [1]]
    lengths = np.random.default_rng(1).integers(1, 1024, 3000)
    bins = P.best_two_fit(lengths, 1024)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert max(lengths[b].sum() for b in bins) <= 1024
    assert len(bins) <= -(-lengths.sum() // 1024) * 1.01


def test_pack(spark, docs_of, documents):
    assert hold(P.pack(docs_of(MESS), BYTE_BPE).collect(), MESS) > 0
    pairs = [(r.doc_id, r.text) for r in documents.collect()]
    rows = P.pack(documents, BYTE_BPE).collect()
    n = hold(rows, pairs)
    assert n <= -(-sum(r.length for r in rows) // P.SIZE) * 1.02
    assert P.pack(docs_of([]), BYTE_BPE).count() == 0


@pytest.mark.parametrize("group", [1, 7])
def test_groups_only_move_bins(documents, group):
    cut = P.pieces(documents.select("doc_id", "text"), BYTE_BPE)
    assert P.packed(cut, group=group * 20).count() == cut.count()
