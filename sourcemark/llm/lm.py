"""A hierarchical Pitman-Yor model of word pairs, learnt from and applied to whole texts.

Each word before is a restaurant whose customers are the words after it; all of them
share one parent, the restaurant of single words, over a uniform base of the V known
words and one for all others. A table is a customer of the parent.

Seating is sampled by blocked Gibbs: a sweep seats all customers of every dish anew, in
the leaves given the parent and then in the parent, each dish given all the others. With
a the weight of a new table, d the discount and c customers, that conditional of the
Chinese restaurant is this one: a Poisson number of tables (mean a / d), each of a Sibuya
size (d), which add up to c. Marked by one customer, a table holds what the others leave;
the others are drawn freely, tilted so that they take about c - 1, and the draw is
accepted or not by the Metropolis ratio of the marked table's weights, so that the
conditional is exact for dishes of any number of customers, at a cost by their tables.
The scores are the predictive probabilities averaged over the sweeps after the first ones.

Texts are coded once into shards of about SHARD bytes. A shard asks for what it needs,
and gives what it knows, in sorted arrays of 64-bit keys, one for each range of keys (a
bucket): equal keys meet in one bucket, counted per shard before, and the answers go
back to the shards that asked. So no key, context or document is ever a row of its own,
none is dropped, and a frequent one weighs as much as any other. Exchanges:

1. pairs: counts, and which shard owns a pair, that is, seats its customers;
2. words: counts, and the pairs of one customer, whose seating is settled;
3. for each sweep, words of an owner's other pairs: tables by context and by dish, the
   parent's seating, and both weights back. Only this small part of a shard moves;
4. the sweeps' weights of all words, and mean tables of pairs, for the scores.

Defined cases: a null text is empty and has the one token END; a long text is coded whole,
in a shard of its own if need be; a null id stays null and is dealt by the empty text's
crc; repeated rows count and are scored each; further columns are ignored; an empty table
gives no rows; without a training text every token has the base's probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, U64, Words, batch_of, chunks, col, dropped, mix, saved, utf8

#: Discounts and strengths of leaves and root; sweeps (at the start all customers of a leaf's dish share a table), of which the first aren't averaged; draws for a dish in a sweep.
LEAF, ROOT, SWEEPS, FIRST, DRAWS = (0.8, 1.0), (0.6, 1.0), 4, 1, 3
SHARD = 16 << 20
END = U64(0x5BD1E995A5A5A5A5)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
MESSAGE = "shard long, kind int, bucket int, a binary, b binary, c binary, d binary, e binary, n double, m double"
#: What a message holds: coded texts, pairs, words, seats of an owner, keys of pairs of several customers, tables by word, the state of a bucket of words, totals.
TEXTS, PAIR, WORD, SEATS, KEYS, TABLES, STATE, TOTAL = range(8)
_P = U64(0xA0761D6478BD642F)


def pack(x: np.ndarray) -> bytes:
    """Compressed, all first bytes first, then all second ones, ..."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b"")


def unpack(raw: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1) if len(planes) else np.zeros(0, kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    return pack(np.diff(keys, prepend=np.zeros(1, np.uint64)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)


def row(shard: int, kind: int, bucket: int = -1, *arrays: bytes, n: float | None = None, m: float | None = None) -> tuple:
    return (shard, kind, bucket, *arrays, *[None] * (5 - len(arrays)), n, m)


def message(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in MESSAGE.split(", ")), strict=True)
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    return batch_of(**{n: pa.array([r[i] for r in rows], types[k]) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def by_bucket(number: int, kind: int, keys: np.ndarray, bits: int, *columns: np.ndarray) -> list[tuple]:
    """Messages of the keys (ascending) of each bucket (their first bits) and what goes with them."""
    cut = np.searchsorted(keys >> U64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).tolist()
    return [row(number, kind, b, pack_sorted(keys[i:j]), *(pack(c[i:j]) for c in columns)) for b, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if j > i]


class Shard:
    """Coded texts: ids, held (not for training), sizes in tokens, sorted word hashes, and tokens as places in them."""

    def __init__(self, ids: list, held: np.ndarray, sizes: np.ndarray, words: np.ndarray, tokens: np.ndarray):
        self.ids, self.held, self.sizes, self.words, self.tokens = ids, held, sizes, words, tokens

    @classmethod
    def coded(cls, batches: list[pa.RecordBatch]) -> Shard:
        hashes, sizes = [], []
        for batch in batches:
            w = Words(*utf8(batch.column("text")))
            n = np.diff(w.first)
            h = np.full(len(w.hash) + len(n), END, np.uint64)
            h[np.arange(len(w.hash)) + w.row] = w.hash
            hashes.append(h)
            sizes.append(n + 1)
        words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        ids = [x for b in batches for x in b.column("doc_id").to_pylist()]
        held = np.concatenate([b.column("held_out").to_numpy(zero_copy_only=False) for b in batches])
        return cls(ids, held.astype(bool), np.concatenate(sizes), words, tokens)

    def coded_row(self, number: int) -> tuple:
        known = np.array([x is not None for x in self.ids])
        docs = np.concatenate([np.array([x or 0 for x in self.ids], np.int64), known, self.held, self.sizes]).astype(np.int64)
        # words by falling frequency: places of frequent ones are small numbers
        order = np.argsort(-np.bincount(self.tokens, minlength=len(self.words)), kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        return row(number, TEXTS, -1, pack(docs), pack(self.words[order]), pack(place[self.tokens]))

    @classmethod
    def of(cls, a: bytes, b: bytes, c: bytes) -> Shard:
        ids, known, held, sizes = unpack(a, np.int64).reshape(4, -1)
        words = unpack(b, np.uint64)
        order = np.argsort(words)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return cls([x if k else None for x, k in zip(ids.tolist(), known.tolist(), strict=True)], held > 0, sizes, words[order], place[unpack(c, np.int32)])

    def pairs(self) -> None:
        """Distinct (context, word) pairs in the order of their keys: u, v, key, count in training texts; at: each token's pair."""
        end = int(np.searchsorted(self.words, END))
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = end
        n = len(self.words)
        pair, at = np.unique(before * n + self.tokens, return_inverse=True)
        u, v = pair // n, pair % n
        key = mix(self.words[u] * _P + self.words[v])
        order = np.argsort(key, kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        self.u, self.v, self.key, self.at = u[order], v[order], key[order], back[at]
        train = np.repeat(~self.held, self.sizes)
        self.count = np.bincount(self.at[train], minlength=len(pair))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by Stirling's series from x + 8 on."""
    z = x + 8.0
    out = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3)
    for k in range(8):
        out -= np.log(x + k)
    return out


def sibuya(n: int, tilt: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Sizes with P(s) as Sibuya's times tilt**s."""
    out, left = np.zeros(n), np.arange(n)
    while len(left):
        size = rng.geometric(np.maximum(rng.beta(discount, 1 - discount, len(left)), 1e-15)).astype(float)
        ok = rng.random(len(left)) < tilt[left] ** (size - 1)
        out[left[ok]] = size[ok]
        left = left[~ok]
    return out


def reseated(count: np.ndarray, weight: np.ndarray, tables: np.ndarray, marked: np.ndarray, discount: float, rng: np.random.Generator, draws: int = DRAWS) -> tuple[np.ndarray, np.ndarray]:
    """Tables, and customers at the marked one, of dishes with at least two customers after a sweep, given a new table's weight."""
    c, at = count.astype(float), np.log(weight)
    # others at the tables take c - 1 on average: weight * x * (1 - x) ** (d - 1) = c - 1, by halving log(1 - x)
    low, high = np.full(len(c), -60.0), np.full(len(c), -1e-9)
    for _ in range(16):
        mid = (low + high) / 2
        more = at + np.log(-np.expm1(mid)) + (discount - 1) * mid > np.log(c - 1)
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    x = -np.expm1(high)
    mean = weight / discount * -np.expm1(discount * high)

    def size_weight(r: np.ndarray) -> np.ndarray:
        return log_gamma(r - discount) - log_gamma(r) + r * np.log(x)

    t, r = tables.astype(float), marked.astype(float)
    now = size_weight(r)
    for _ in range(draws):
        others = rng.poisson(mean)
        many = others >= c  # can't be right
        others[many] = 0
        owner = np.repeat(np.arange(len(c)), others)
        rest = c - np.bincount(owner, sibuya(len(owner), x[owner], discount, rng), len(c))
        new = size_weight(np.maximum(rest, 1))
        ok = ~many & (rest >= 1) & (np.log(rng.random(len(c))) < new - now)
        t, r, now = np.where(ok, others + 1.0, t), np.where(ok, rest, r), np.where(ok, new, now)
    return t, r


def _grouped(parts: list[DataFrame], key: str, make) -> DataFrame:
    """Per shard or bucket, make(number, rows by kind) -> messages."""

    def run(group: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        rows: dict[int, list[dict]] = {}
        for r in sorted(held.to_pylist(), key=lambda r: (r["shard"], r["bucket"])):
            rows.setdefault(r["kind"], []).append(r)
        made = make(group[0].as_py(), rows)
        return pa.Table.from_batches([message(made) if isinstance(made, list) else made])

    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(key).applyInArrow(run, getattr(make, "schema", MESSAGE))


def _only(answers: DataFrame, *columns: str) -> DataFrame:
    """Answers without what the next step doesn't read."""
    return answers.select([F.col(c) if c not in "abcde" or c in columns else F.lit(None).cast("binary").alias(c) for c in answers.columns])


def _joined(rows: list[dict], column: str, kind) -> np.ndarray:
    return np.concatenate([unpack(r[column], kind) for r in rows])


def _merged(rows: list[dict], *columns: tuple[str, type]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[int]]:
    """Distinct keys of a bucket, each entry's place in them, the columns' entries, and where each shard's end."""
    each = [unpack_sorted(r["a"]) for r in rows]
    keys, at = np.unique(np.concatenate(each), return_inverse=True)
    return keys, at, [_joined(rows, c, k) for c, k in columns], np.cumsum([len(x) for x in each])[:-1].tolist()


def coded(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """Shards of docs: doc_id, held_out, text."""

    def run(batches):
        base, number, held, n = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in chunks(batches, limit=min(CHUNK_BYTES, size)):
            held.append(batch)
            n += len(utf8(batch.column("text"))[0]) + 64 * batch.num_rows
            if n >= size:
                yield message([Shard.coded(held).coded_row(base + number)])
                number, held, n = number + 1, [], 0
        if held:
            yield message([Shard.coded(held).coded_row(base + number)])

    return docs.mapInArrow(run, MESSAGE)


def scored(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id", sweeps: int = SWEEPS) -> DataFrame:
    """Every row of docs with its tokens, those known, the training tokens, log10 probabilities by the base and the model, and the perplexity of its tokens."""
    named = docs.select(col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), col(text).alias("text"))
    shards = saved(coded(named))
    bits = max(2, int(shards.count()).bit_length())
    d1, s1 = LEAF
    d0, s0 = ROOT

    def ask_pairs(batches):
        for batch in batches:
            for r in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                shard = Shard.of(r["a"], r["b"], r["c"])
                shard.pairs()
                yield message(by_bucket(r["shard"], PAIR, shard.key, bits, shard.count.astype(np.int32)))

    def tell_pairs(bucket, rows):
        keys, at, (count,), cut = _merged(rows[PAIR], ("b", np.int32))
        total = np.bincount(at, count, len(keys)).astype(np.int64)
        seen = np.flatnonzero(count > 0)
        first = np.full(len(keys), -1)
        first[at[seen[::-1]]] = seen[::-1]
        owned = np.zeros(len(at), np.uint8)
        owned[first[first >= 0]] = 1
        return [row(r["shard"], PAIR, bucket, pack(x), pack(y)) for r, x, y in zip(rows[PAIR], np.split(total[at], cut), np.split(owned, cut), strict=True)]

    counts = saved(_grouped([shards.mapInArrow(ask_pairs, MESSAGE)], "bucket", tell_pairs))

    def settle(k, rows):
        """Words with the pairs of one customer, seats of the others, and their keys."""
        own = rows[TEXTS][0]
        shard = Shard.of(own["a"], own["b"], own["c"])
        shard.pairs()
        total, owned = _joined(rows[PAIR], "a", np.int64), _joined(rows[PAIR], "b", np.uint8) > 0
        n, one, many = len(shard.words), owned & (total == 1), owned & (total > 1)
        said = np.bincount(shard.tokens[np.repeat(~shard.held, shard.sizes)], minlength=n)
        out = by_bucket(k, WORD, shard.words, bits, *(x.astype(np.int32) for x in (said, np.bincount(shard.u[one], minlength=n), np.bincount(shard.v[one], minlength=n))))
        words, place = np.unique(np.concatenate([shard.u[many], shard.v[many]]), return_inverse=True)
        c = total[many]
        out.append(row(k, SEATS, -1, pack(shard.words[words]), pack(place.astype(np.int32)), pack(c), pack(np.stack([np.ones(len(c)), c, np.zeros(len(c))]).ravel())))
        some = total > 1
        return out + by_bucket(k, KEYS, shard.key[some], bits, owned[some].astype(np.uint8))

    first = saved(_grouped([shards, counts], "shard", settle))

    def tell_words(bucket, rows):
        keys, at, columns, cut = _merged(rows[WORD], ("b", np.int32), ("c", np.int32), ("d", np.int32))
        said, context, dish = (np.bincount(at, x, len(keys)).astype(np.int64) for x in columns)
        out = [row(r["shard"], WORD, bucket, pack(x)) for r, x in zip(rows[WORD], np.split(said[at], cut), strict=True)]
        state = [pack_sorted(keys), pack(context), pack(dish), pack(np.zeros(2 * len(keys), np.float64)), pack(np.zeros(0, np.float32))]
        return [*out, row(-1, STATE, bucket, *state), row(-2, TOTAL, bucket, n=float(said.sum()), m=float((said > 0).sum()))]

    words = saved(_grouped([first.where(F.col("kind") == WORD)], "bucket", tell_words))

    def totals(told: DataFrame) -> tuple[float, float]:
        r = told.where(F.col("kind") == TOTAL).agg(F.sum("n").alias("n"), F.sum("m").alias("m")).first()
        return r.n or 0.0, r.m or 0.0

    tokens, known = totals(words)

    def parent(gain: np.ndarray, customers: float, tables: float) -> np.ndarray:
        return (gain + (s0 + d0 * tables) / (known + 1)) / (s0 + customers)

    def seats(sweep: int, customers: float, tables: float):
        def sit(k, rows):
            own = rows[SEATS][0]
            word, c = unpack(own["a"], np.uint64), unpack(own["c"], np.int64)
            u, v = unpack(own["b"], np.int32).reshape(2, -1)
            t, r, total = unpack(own["d"], np.float64).reshape(3, -1)
            if sweep and len(c):
                context, gain = _joined(rows[TABLES], "a", np.float64), _joined(rows[TABLES], "b", np.float64)
                weight = (s1 + d1 * context[u]) * parent(gain, customers, tables)[v]
                t, r = reseated(c, weight, t, r, d1, np.random.default_rng([sweep, k]))
                total = total + t if sweep > FIRST else total
            state = row(k, SEATS, -1, own["a"], own["b"], own["c"], pack(np.stack([t, r, total]).ravel()))
            return [state, *by_bucket(k, TABLES, word, bits, *(np.bincount(x, t, len(word)).astype(float) for x in (u, v)))]

        return sit

    def guests(sweep: int):
        def serve(bucket, rows):
            own, asked = rows[STATE][0], rows.get(TABLES, [])
            keys = unpack_sorted(own["a"])
            context, dish = (unpack(own[x], np.int64).astype(float) for x in "bc")
            t, others = unpack(own["d"], np.float64).reshape(2, -1)  # tables, and customers not at the marked one
            past = unpack(own["e"], np.float32)
            each = [unpack_sorted(x["a"]) for x in asked]
            at, cut = np.searchsorted(keys, np.concatenate([keys[:0], *each])), np.cumsum([len(x) for x in each])[:-1].tolist()
            more = [np.concatenate([np.zeros(0), *(unpack(x[c], np.float64) for x in asked)]) for c in "bc"]
            context, dish = context + np.bincount(at, more[0], len(keys)), dish + np.bincount(at, more[1], len(keys))
            # who came sits at the marked table, who went was there; where too many went, all sit at one
            few = dish - others < 1
            t, others = np.where(few, dish > 0, np.maximum(t, 1)).astype(float), np.where(few, 0, others)
            some = np.flatnonzero(dish > 1)
            if len(some):
                # the base's weight of a new table, as if each word had one
                weight = np.full(len(some), (s0 + d0 * known) / (known + 1))
                t[some], marked = reseated(dish[some], weight, t[some], dish[some] - others[some], d0, np.random.default_rng([sweep, bucket, 1]))
                others[some] = dish[some] - marked
            gain = np.maximum(0, dish - d0 * t)
            past = np.concatenate([past, context.astype(np.float32), gain.astype(np.float32)]) if sweep > FIRST else past
            out = [row(x["shard"], TABLES, bucket, pack(y), pack(z)) for x, y, z in zip(asked, np.split(context[at], cut), np.split(gain[at], cut), strict=False)]
            state = row(-1, STATE, bucket, own["a"], own["b"], own["c"], pack(np.concatenate([t, others])), pack(past))
            return [*out, state, row(-2, TOTAL, bucket, n=float(dish.sum()), m=float(t.sum()))]

        return serve

    state, told = first.where(F.col("kind") == SEATS), words.where(F.col("kind") == STATE)
    customers, seated, sums, old = 0.0, known, [], []
    for sweep in range(sweeps + 1):
        parts = [state] + ([told.where(F.col("kind") == TABLES)] if sweep else [])
        sat = saved(_grouped(parts, "shard", seats(sweep, customers, seated)))
        state = sat.where(F.col("kind") == SEATS)
        told = saved(_grouped([sat.where(F.col("kind") == TABLES), told.where(F.col("kind") == STATE)], "bucket", guests(sweep)))
        customers, seated = totals(told)
        sums += [(customers, seated)] if sweep > FIRST else []
        dropped(*old)
        old = [sat, told]
    used = len(sums)

    def mean_tables(k, rows):
        """An owner's mean tables, for its keys' buckets; 0 for the pairs of others."""
        keys, owned = (np.concatenate(x) for x in zip(*((unpack_sorted(r["a"]), unpack(r["b"], np.uint8)) for r in rows[KEYS]), strict=True)) if KEYS in rows else (np.zeros(0, np.uint64), np.zeros(0, np.uint8))
        total = np.zeros(len(keys), np.float32)
        total[owned > 0] = unpack(rows[SEATS][0]["d"], np.float64).reshape(3, -1)[2] / used
        return by_bucket(k, KEYS, keys, bits, total)

    def tell_tables(bucket, rows):
        keys, at, (total,), cut = _merged(rows[KEYS], ("b", np.float32))
        return [row(r["shard"], KEYS, bucket, pack(x)) for r, x in zip(rows[KEYS], np.split(np.bincount(at, total, len(keys)).astype(np.float32)[at], cut), strict=True)]

    pairs = saved(_grouped([_grouped([first.where(F.col("kind") == KEYS), state], "shard", mean_tables)], "bucket", tell_tables))

    def tell_weights(bucket, rows):
        own = rows[STATE][0]
        keys, past = unpack_sorted(own["a"]), unpack(own["e"], np.float32)
        past = past.reshape(2 * used, -1)
        return [row(r["shard"], TABLES, bucket, pack(past[:, np.searchsorted(keys, unpack_sorted(r["a"]))].ravel())) for r in rows[WORD]]

    asked = first.where(F.col("kind") == WORD).withColumns({c: F.lit(None).cast("binary") for c in "bcd"})
    weights = saved(_grouped([asked, told.where(F.col("kind") == STATE)], "bucket", tell_weights))
    dropped(first, *old)

    def score(_, rows):
        own = rows[TEXTS][0]
        shard = Shard.of(own["a"], own["b"], own["c"])
        shard.pairs()
        c, total = _joined(rows[WORD], "a", np.int64), _joined(rows[PAIR], "a", np.int64)
        past = np.concatenate([unpack(r["a"], np.float32).reshape(2 * used, -1) for r in rows[TABLES]], 1).astype(float)
        tables = (total > 0).astype(float)
        if KEYS in rows:
            tables[total > 1] = _joined(rows[KEYS], "a", np.float32)
        seen, p = np.maximum(0, total - d1 * tables), np.zeros(len(total))
        for (customers, seated), context, gain in zip(sums, past[::2], past[1::2], strict=True):
            above = parent(gain, customers, seated)[shard.v]
            heard = c[shard.u] > 0
            p += np.where(heard, (seen + (s1 + d1 * context[shard.u]) * above) / (s1 + c[shard.u]), above) / used
        base = np.log10((c + 0.5) / (tokens + 0.5 * (known + 1)))
        first = np.cumsum(shard.sizes) - shard.sizes
        sums_of = [np.add.reduceat(x, first) for x in ((c > 0).astype(np.int64)[shard.tokens], base[shard.tokens], np.log10(p)[shard.at])]
        return batch_of(doc_id=pa.array(shard.ids, pa.int64()), held_out=pa.array(shard.held), n_tokens=pa.array(shard.sizes, pa.int64()), n_known=pa.array(sums_of[0], pa.int64()), train_tokens=pa.array(np.full(len(first), int(tokens)), pa.int64()), base_score=pa.array(sums_of[1]), score=pa.array(sums_of[2]), perplexity=pa.array(10 ** (-sums_of[2] / shard.sizes)))

    score.schema = SCHEMA
    return _grouped([shards, _only(counts, "a"), words.where(F.col("kind") == WORD), pairs, weights], "shard", score)
