"""Benchmark items in documents, by windows of their templates.

A template has each word lower-cased, without the marks around it, and numbers,
units and names (capitalised words within a sentence) replaced by a typed slot.
Windows of WINDOW template words are joined by hash. A document holds an item if the
windows that meet cover a sufficient part of the item and the slots' values agree:
one value of the item stands for one value of the document throughout, and the other
way round, so an item asked with other numbers or names is caught as well. Values are
bound anew for each occurrence, that is windows as far apart in the document as in the
item, and what else stands within an item's length and agrees; for the values as they
stand in the item; and for the document as a whole. The best of these counts. Windows of
fewer than LITERALS words that are no slots would meet by their slots alone: these, and
items of one window, are joined by their words as they stand, so that a copy is found
whatever its words are. The share is the larger of that of all the item's windows and
that of those joined by template.

Benchmark items are a stated query set: they are sent to all documents in blocks of
BLOCK_CHARS characters, one pass each.

Defined cases: null texts are empty and hold nothing; an item of fewer words than a
window is one window, found in documents of any length; an item without a letter or
digit matches nothing; null ids stay null;
repeated documents are each answered, repeated items too; further columns are ignored
(leaks) or kept as they were (without_leaks).
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, batch_of, chunks, col, kept_rows, mix, powers, utf8

WINDOW, LITERALS, SHARE, BLOCK_CHARS = 8, 4, 0.2, 8_000_000
SCHEMA = "doc_id long, item_id long, n_windows long, share double, exact boolean"
#: Units of measure that count as one slot.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec min h hr hrs ms w kw v a hz kb mb gb tb eur usd gbp percent dollars euros pounds cents miles meters metres kilometers grams kilograms litres liters hours minutes seconds days weeks months years".split())
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_NUMBER = re.compile(r"[+-]?[0-9]+(?:[.,:/][0-9]+)*")
_PART = re.compile(r"[0-9]+(?:[.,][0-9]+)*|[^0-9]+")
_SLOT = {"number": 1, "unit": 2, "name": 3}
_P = 0xD6E8FEB86659FD93
_P_INVERSE = pow(_P, -1, 1 << 64)


class Canon:
    """Template words by the hash of the word as written: literal's hash, slot, capitalised, ends a sentence."""

    def __init__(self, limit: int = 300_000):
        self.limit, self.at = limit, {}
        self.rows = np.zeros((0, 3), np.uint64)

    @staticmethod
    def word(raw: str) -> tuple[int, int]:
        """(slot or 0, flags: 1 capitalised, 2 ends a sentence)."""
        core = _EDGE.sub("", raw)
        flags = 2 * bool(re.search(r"[.!?:]\W*$", raw))
        if _NUMBER.fullmatch(core) or (core[:1].isdigit() and any(x.isdigit() for x in core) and all(p[0].isdigit() or p.lower() in UNITS for p in _PART.findall(core))):
            return 1, flags
        if core.lower() in UNITS and len(core) > 1 or raw.strip() in ("%", "$", "€", "£"):
            return 2, flags
        return 0, flags + (core[:1].isupper() and not (len(core) > 1 and core.isupper()))

    def look(self, w: Words) -> np.ndarray:
        distinct, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.at) > self.limit:
            self.at, self.rows = {}, np.zeros((0, 3), np.uint64)
        keys = distinct.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.at]
        if new:
            made = np.zeros((len(new), 3), np.uint64)
            raws = [w.text(first[i]) for i in new]
            cores = [(_EDGE.sub("", r) or r).lower().encode() for r in raws]
            offs = np.cumsum([0, *(len(c) + 1 for c in cores)])
            plain = Words(np.frombuffer(b"\n".join([*cores, b""]), np.uint8), offs)
            made[:, 0] = plain.hash[plain.first[:-1]] if len(plain.hash) == len(new) else np.array([Words(np.frombuffer(re.sub(rb"\s", b"", c) or b"-", np.uint8), np.array([0, len(re.sub(rb"\s", b"", c) or b"-")])).hash[0] for c in cores])
            made[:, 1:] = np.array([self.word(r) for r in raws], np.uint64)
            self.at.update(zip((keys[i] for i in new), range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, made])
        return self.rows[np.fromiter((self.at[k] for k in keys), np.int64, len(keys))[inverse]] if len(inverse) else np.zeros((0, 3), np.uint64)


class Templates:
    """Of a batch of texts: the words, per word its slot and value, and the hashes of windows."""

    def __init__(self, texts: pa.Array, canon: Canon):
        self.words = w = Words(*utf8(texts), lower=False)
        rows = canon.look(w)
        self.value, self.slot, flags = rows[:, 0], rows[:, 1].astype(np.int64), rows[:, 2].astype(np.int64)
        opens = np.ones(len(flags), bool)
        opens[1:] = flags[:-1] & 2 > 0
        firsts = w.first[:-1]
        opens[firsts[firsts < len(opens)]] = True
        # a word that opens a line opens a sentence as well
        breaks = np.concatenate([[0], np.cumsum(w.data == 10)])
        if len(opens) > 1:
            opens[1:] |= breaks[w.start[1:]] > breaks[w.end[:-1]]
        self.slot[(self.slot == 0) & (flags & 1 > 0) & ~opens] = _SLOT["name"]
        h = np.where(self.slot > 0, mix(self.slot.astype(np.uint64)), self.value)
        n = len(h)
        self.row = w.row
        self.left = w.first[1:][self.row] - np.arange(n)  # words from here to the text's end
        self.n_words = np.diff(w.first)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers(n, _P), dtype=np.uint64)]) for x in (h, self.value)]

    def windows(self, size: int, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of so many words start, and their hashes: of the template, or of the plain words."""
        at, sums = np.flatnonzero(self.left >= size), self.sums[plain]
        total = (sums[at + size] - sums[at]) * powers(len(self.left), _P_INVERSE)[at]
        return at, mix(total + U64(size * _P % (1 << 64)))


class Block:
    """A bounded part of the benchmark, as sorted window hashes."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW, literals: int = LITERALS):
        self.ids = [i for i, _ in items]
        self.t = t = Templates(pa.array([x for _, x in items], pa.string()), Canon())
        self.size = np.minimum(t.n_words, window)
        worded = np.array([bool(re.search(r"[^\W_]", x or "")) for _, x in items], bool)
        fixed = np.concatenate([[0], np.cumsum(t.slot == 0)])
        self.rich, self.n_all = np.zeros(len(t.row), bool), np.zeros(len(items), np.int64)
        self.index: list[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray]] = []  # size, plain, hashes, places, which low bits occur
        for size in np.unique(self.size[worded]).tolist():
            for plain in (False, True):
                at, h = t.windows(size, plain)
                mine = worded[t.row[at]] & (self.size[t.row[at]] == size)
                at, h = at[mine], h[mine]
                enough = fixed[at + size] - fixed[at] >= min(literals, size)
                if not plain:
                    self.rich[at[enough]] = True
                    self.n_all += np.bincount(t.row[at], minlength=len(items))
                use = ~enough | (t.n_words[t.row[at]] <= window) if plain else enough
                order = np.argsort(h[use], kind="stable")
                low = np.zeros(1 << 20, bool)
                low[h[use] & U64(len(low) - 1)] = True
                if use.any():
                    self.index.append((size, plain, h[use][order], at[use][order], low))
        self.n_rich = np.bincount(t.row[self.rich], minlength=len(items))

    def met(self, d: Templates) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of documents and of items start that meet."""
        mine, theirs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, plain, known, places, low in self.index:
            at, h = d.windows(size, plain)
            may = low[h & U64(len(low) - 1)]
            at, h = at[may], h[may]
            lo, hi = np.searchsorted(known, h), np.searchsorted(known, h, "right")
            each = np.repeat(np.arange(len(h)), hi - lo)
            mine.append(at[each])
            theirs.append(places[np.arange(len(each)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[each]])
        return np.concatenate(mine), np.concatenate(theirs)

    def matches(self, texts: pa.Array, canon: Canon, share: float) -> list[tuple[int, int, int, float, bool]]:
        """(text, item, distinct windows of the item, their share, every slot has the item's value)."""
        if not self.index:
            return []
        d, t = Templates(texts, canon), self.t
        mine, theirs = self.met(d)
        if not len(mine):
            return []
        text, item = d.row[mine], t.row[theirs]
        order = np.lexsort((theirs, item, text))
        text, item, mine, theirs = text[order], item[order], mine[order], theirs[order]
        cut = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])]))
        out = []
        for a, b in zip(cut, [*cut[1:], len(text)], strict=True):
            part, there, same = self.best(d, int(item[a]), mine[a:b], theirs[a:b])
            if there and part >= share:
                out.append((int(text[a]), int(item[a]), there, part, same))
        return out

    def best(self, d: Templates, item: int, mine: np.ndarray, theirs: np.ndarray) -> tuple[float, int, bool]:
        """Share, number of windows and whether all values are the item's, of the best binding of values; of one item's meetings with a text, by windows of the item."""
        t, size = self.t, int(self.size[item])
        slots: dict[int, list[int]] = {y: [j for j in range(size) if t.slot[y + j]] for y in set(theirs.tolist())}
        at = []  # place in the document, window of the item, pairs of values
        for x, y in zip(mine.tolist(), theirs.tolist(), strict=True):
            pairs = {(int(t.value[y + j]), int(d.value[x + j])) for j in slots[y]}
            if len({p for p, _ in pairs}) == len({q for _, q in pairs}) == len(pairs):
                at.append((x, y, pairs))

        def bound(meetings) -> tuple[float, int, bool]:
            there, forth, back, same = set(), {}, {}, True
            for _, y, pairs in meetings:
                if y not in there and all(forth.get(p, q) == q and back.get(q, p) == p for p, q in pairs):
                    forth.update(pairs)
                    back.update((q, p) for p, q in pairs)
                    there.add(y)
                    same &= all(p == q for p, q in pairs)
            return (self.share(item, there), len(there), same) if there else (0.0, 0, False)

        def better(old, new):
            return max(old, new, key=lambda x: (x[0], x[2], x[1]))

        exact = [m for m in at if all(p == q for p, q in m[2])]
        best = better(bound(at), bound(exact))
        if best[0] == 1 and best[2]:
            return best
        best = better(best, bound([*exact, *at]))
        at.sort(key=lambda m: m[:2])
        places, runs = [m[0] for m in at], {}
        for m in at:
            runs.setdefault(m[0] - m[1], []).append(m)
        reach = int(t.n_words[item]) + size
        for run in runs.values():
            near = at[bisect_left(places, run[0][0] - reach) : bisect_right(places, run[-1][0] + reach)]
            best = better(best, bound(itertools.chain(run, near)))
            if best[0] == 1:
                break
        return best

    def share(self, item: int, there: set[int]) -> float:
        return max(len(there) / int(self.n_all[item]), sum(self.rich[y] for y in there) / max(1, int(self.n_rich[item])))


def blocks(items: DataFrame, limit: int = BLOCK_CHARS) -> list[list[tuple]]:
    """item_id, text of the items with a text, in parts of about so many characters; each is fetched when its turn comes."""
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    parts = max(1, -(-total // limit))
    for k in range(parts):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).select(F.col("item_id").cast("long"), "text")
        yield sorted(((r.item_id, r.text) for r in some.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))


def leaks(docs: DataFrame, items: DataFrame, share: float = SHARE, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Per document and item that it holds: windows met, their share of the item's, and whether all slots keep their values."""
    items = items.select(col(item_id).alias("item_id"), col(item_text).alias("text"))
    named = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))
    out = None
    for part in blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(Block(part))

        def run(batches, shared=shared):
            block, canon = shared.value, Canon()
            for batch in chunks(batches):
                if met := block.matches(batch.column("text"), canon, share):
                    rows, which, n, part, same = zip(*met, strict=True)
                    yield batch_of(doc_id=batch.column("doc_id").take(pa.array(rows, pa.int32())), item_id=pa.array([block.ids[i] for i in which], pa.int64()), n_windows=pa.array(n, pa.int64()), share=pa.array(part, pa.float64()), exact=pa.array(same, pa.bool_()))

        found = named.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, share: float = SHARE, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of docs that hold no item, all their columns as they were."""
    items = items.select(col(item_id).alias("item_id"), col(item_text).alias("text"))
    for part in blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(Block(part))

        def keep(shared=shared):
            block, canon = shared.value, Canon()

            def free(texts: pa.Array) -> np.ndarray:
                out = np.ones(len(texts), bool)
                out[[m[0] for m in block.matches(texts, canon, share)]] = False
                return out

            return free

        docs = kept_rows(docs, text, keep)
    return docs
