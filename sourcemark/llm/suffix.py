"""Removal of byte strings of a given length that start anywhere else as well.

Suffix arrays of shards are built by induced sorting: suffixes are classed as smaller or
larger than the next, leftmost-smaller substrings are sorted and named recursively, and
all other suffixes are induced from them, here for as many buckets at a time as do not
feed one another. Permuted common prefixes come from the irreducible ones.

To bring equal strings into one shard, each window of `length` bytes is filed under its
least seed (by the hash of SEED bytes within it), as equal windows have equal least seeds
at equal distances: under the half in which that distance lies, and the bytes around the
seed that all windows of the half share. Neighbouring windows with one seed and half make
a region. Regions are counted by their bytes: equal regions repeat as a whole, a key met
once repeats nowhere, and of the other keys one copy of each distinct region goes to the
key's shard. A key with more than MOST distinct regions is split again and again into
halves filed under what their windows share: so no shard depends on how often a passage
occurs, and none is left out.

Defined cases: a null text is empty; texts shorter than `length` lose nothing; long ones
are looked at by segments, every window of them; which of equal strings comes first
doesn't matter, all of them go; a null id stays null; repeated rows are documents of their own (each repeats the other); further
columns are ignored; an empty table gives no rows. Regions are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _INVERSE, U64, batch_of, chunks, col, mix, powers, prefix_hash, saved, span_hash, utf8, whole_runs

LENGTH = 400
#: Bytes of a seed; distinct regions of one seed that a shard takes; bytes of a shard; shards of a task, if there are more of them than partitions.
SEED, MOST, SHARD, EACH = 32, 1000, 1 << 20, 16
#: Starts of windows of one text that are looked at together; bytes of texts that are, as a processor's cache holds them; bits for a place among them.
SEGMENT, TOGETHER, PLACE = 1 << 20, 1 << 15, 32
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_SECOND = np.random.default_rng(44).integers(1, 2**63, 256, dtype=np.uint64)


def least_in_windows(x: np.ndarray, size: int) -> np.ndarray:
    """The place of the leftmost least value of every x[i:i + size]; values below 2**(64 - PLACE), fewer than 2**PLACE of them."""
    n = len(x)
    full = np.full((-(-n // size), size), np.iinfo(np.uint64).max, np.uint64)
    # with its place below it each value is met once: the least one tells where it stands
    full.ravel()[:n] = x << U64(PLACE) | np.arange(n, dtype=np.uint64)
    ahead = np.minimum.accumulate(full, 1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(back[: n - size + 1], ahead[size - 1 : n]) & U64((1 << PLACE) - 1)).astype(np.int64)


def regions(data: np.ndarray, offs: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Per run of a text's windows with one least seed in one half of its distances: row, p (the seed's place), lo, hi (first start, end of the last window), h (the hash of the bytes that any window of that seed and half holds), r1, r2 (of the bytes and the place).

    Texts stand in data from offs to offs and are looked at TOGETHER bytes at a time, a
    longer one by SEGMENT starts at a time: its length doesn't matter.
    """
    parts, at, names = [], 0, ("row", "p", "lo", "hi", "h", "r1", "r2")
    while at < len(offs) - 1:
        stop = max(at + 1, int(np.searchsorted(offs, offs[at] + TOGETHER, "right")) - 1)
        for a in range(int(offs[at]), int(offs[stop]) - length + 1, SEGMENT):
            part = _segment(data[a : min(a + SEGMENT + length - 1, int(offs[stop]))], offs[at : stop + 1] - a, length)
            base = offs[at + part["row"]] - a
            parts.append(part | {"row": part["row"] + at} | {c: part[c] - base for c in ("p", "lo", "hi")})
        at = stop
    return {c: np.concatenate([np.zeros(0, np.int64), *(x[c] for x in parts)]) for c in names}


def _segment(data: np.ndarray, offs: np.ndarray, length: int) -> dict[str, np.ndarray]:
    s = prefix_hash(data)
    starts = len(data) - SEED + 1
    seeds = mix((s[SEED:] - s[:starts]) * powers(starts, _INVERSE))
    place = least_in_windows(seeds >> U64(PLACE), length - SEED + 1)
    n, half = len(place), _half(length)
    far = place - np.arange(n) >= half
    new = np.ones(n + 1, bool)
    new[1:-1] = (place[1:] != place[:-1]) | (far[1:] != far[:-1])
    edge = np.concatenate([offs, offs[1:] - length + 1])  # texts begin, their windows end
    new[edge[(edge > 0) & (edge < n)]] = True
    cut = np.flatnonzero(new)
    row = np.searchsorted(offs, cut[:-1], "right") - 1
    inside = np.flatnonzero(cut[:-1] + length <= offs[row + 1])
    row, lo, hi = row[inside], cut[inside], cut[inside + 1] - 1 + length
    p, far = place[lo], far[lo]
    low, high = np.where(far, half, 0), np.where(far, length - SEED + 1, half)
    # windows start at p - d for low <= d < high
    h = mix(span_hash(s, p - low, p - high + 1 + length) ^ far.astype(np.uint64))
    r1, r2 = (span_hash(x, lo, hi) ^ (p - lo).astype(np.uint64) for x in (s, prefix_hash(data, _SECOND)))
    return {"row": row, "p": p, "lo": lo, "hi": hi, "h": h.view(np.int64), "r1": r1.view(np.int64), "r2": r2.view(np.int64)}


def _half(length: int) -> int:
    """Distances of a window's start to its seed below this make the first half."""
    return (length - SEED + 2) // 2


class Induction:
    """One level of induced sorting; t ends in its only 0."""

    def __init__(self, t: np.ndarray, k: int):
        n = len(t)
        self.t, self.k, self.count = t, k, np.arange(n, dtype=np.int32)
        after = np.where(t[1:] != t[:-1], np.arange(n - 1, dtype=np.int32), np.int32(n - 1))
        after = np.minimum.accumulate(after[::-1])[::-1]
        self.small = np.ones(n, bool)  # smaller than the next suffix
        less = np.append(t[:-1] < t[1:], True)
        self.small[:-1] = less[after]
        self.lms = (np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1).astype(np.int32)
        counts = np.bincount(t, minlength=k)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.larges = np.bincount(t[~self.small], minlength=k)

    def _append(self, sa: np.ndarray, edge: np.ndarray, to: np.ndarray, which: np.ndarray, sign: int) -> None:
        order = to.argsort(kind="stable")
        to, n = to[order], len(to)
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(to[1:], to[:-1], out=new[1:])
        first = new.nonzero()[0]
        size = np.empty_like(first)
        np.subtract(first[1:], first[:-1], out=size[:-1])
        size[-1] = n - first[-1]
        rank = self.count[:n] - first.repeat(size)
        sa[edge[to] + rank if sign > 0 else edge[to] - 1 - rank] = which[order]
        edge[to[first]] += sign * size

    def induce(self, order: np.ndarray) -> np.ndarray:
        """The suffix array, from the leftmost-smaller suffixes in that order."""
        t, small, starts, ends, k = self.t, self.small, self.starts, self.ends, self.k
        sa = np.full(len(t), -1, np.int32)
        edge = ends.copy()
        self._append(sa, edge, t[order[::-1]], order[::-1], -1)
        seeds = edge  # where they begin in each bucket
        head, c, width = starts.copy(), 0, 1
        while c < k:
            stop = min(k, c + width)
            seen = sa[starts[c] : ends[stop - 1]]
            which = seen[seen > 0] - 1
            which = which[~small[which]]
            to = t[which]
            if len(to) and (low := to.min()) < stop:
                if low > c:
                    stop = low
                    which = which[t[which + 1] < stop]
                    to = t[which]
                else:
                    stop, at = c + 1, starts[c]
                    while at < head[c]:
                        seen, at = sa[at : head[c]], head[c]
                        which = seen[seen > 0] - 1
                        which = which[~small[which]]
                        if len(which):
                            self._append(sa, head, t[which], which, 1)
                    which = sa[seeds[c] : ends[c]]
                    which = which[which > 0] - 1
                    which = which[~small[which]]
                    to = t[which]
                width = max(1, stop - c)
            else:
                width = 2 * (stop - c)
            if len(to):
                self._append(sa, head, to, which, 1)
            c = stop
        for b in np.flatnonzero(seeds < ends) if k < 1000 else ():
            sa[seeds[b] : ends[b]] = -1
        if k >= 1000:
            sa[small[np.maximum(sa, 0)] & (sa >= 0)] = -1
        tail, c, width = ends.copy(), k, 1
        while c > 0:
            stop = max(0, c - width)
            seen = sa[starts[stop] : ends[c - 1]][::-1]
            which = seen[seen > 0] - 1
            which = which[small[which]]
            to = t[which]
            if len(to) and (high := to.max()) >= stop:
                if high < c - 1:
                    stop = high + 1
                    which = which[t[which + 1] >= stop]
                    to = t[which]
                else:
                    stop, at = c - 1, ends[c - 1]
                    while at > tail[stop]:
                        seen, at = sa[tail[stop] : at][::-1], tail[stop]
                        which = seen[seen > 0] - 1
                        which = which[small[which]]
                        if len(which):
                            self._append(sa, tail, t[which], which, -1)
                    which = sa[starts[stop] : starts[stop] + self.larges[stop]][::-1]
                    which = which[which > 0] - 1
                    which = which[small[which]]
                    to = t[which]
                width = max(1, c - stop)
            else:
                width = 2 * (c - stop)
            if len(to):
                self._append(sa, tail, to, which, -1)
            c = stop
        sa[0] = len(t) - 1
        return sa


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Of numbers below k, of which the last is the only 0."""
    if len(t) == 1:
        return np.zeros(1, np.int32)
    level = Induction(t, k)
    lms = level.lms
    leftmost = np.zeros(len(t), bool)
    leftmost[lms] = True
    sa = level.induce(lms)
    ranked = sa[leftmost[sa]]
    s = np.zeros(len(t) + 1, np.uint64)
    np.cumsum(mix(t.astype(np.uint64) + U64(1)) * powers(len(t)), dtype=np.uint64, out=s[1:])
    after = np.zeros(len(t), np.int32)
    after[lms] = np.append(lms[1:], lms[-1]) + 1
    h = span_hash(s, ranked, after[ranked])
    names = after
    names[ranked] = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
    named, top = names[lms], int(names[ranked[-1]]) + 1
    del s, after, names, h
    if top == len(lms):
        return sa if len(lms) == 1 else level.induce(ranked)
    return level.induce(lms[suffix_array(named, top)])


def common_prefixes(t: np.ndarray, sa: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """By position: the length shared with the suffix before it in sa (0 if below `least`), and that suffix.

    Only where the letters before two neighbours differ is the length measured; from
    there on it falls by one a position.
    """
    n = len(t)
    before = np.empty(n, np.int32)
    before[sa[1:]], before[sa[0]] = sa[:-1], -1
    irreducible = before < 1
    irreducible[0] = True
    irreducible[1:] |= t[:-1] != t[np.maximum(before[1:], 1) - 1]
    i = np.flatnonzero(irreducible & (before >= 0))
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(t.astype(np.uint64) + U64(1)) * powers(n), dtype=np.uint64, out=s[1:])
    inverse = powers(n + 1, _INVERSE)

    def equal(a: np.ndarray, b: np.ndarray, size) -> np.ndarray:
        return (s[a + size] - s[a]) * inverse[a] == (s[b + size] - s[b]) * inverse[b]

    i = i[np.maximum(i, before[i]) + least <= n]
    i = i[equal(i, before[i], least)]
    j, got = before[i].astype(np.int64), np.full(len(i), least)
    step = 1
    while len(i) and 2 * step <= n:
        step *= 2
    while step and len(i):
        ok = np.flatnonzero(np.maximum(i, j) + got + step <= n)
        ok = ok[equal(i[ok], j[ok], got[ok] + step)]
        got[ok] += step
        step >>= 1
    out = np.zeros(n, np.int32)
    out[i] = got
    at = np.arange(n, dtype=np.int32)
    last = np.maximum.accumulate(np.where(irreducible, at, 0))
    out = np.maximum(0, out[last] - (at - last))
    return np.where(out >= least, out, 0), before


def repeated(texts: list[bytes], length: int) -> list[np.ndarray]:
    """Per text, for each of its windows of `length`, whether it starts elsewhere in the texts too."""
    sizes = np.array([len(x) for x in texts])
    t = np.frombuffer(b"\0".join([*texts, b"\0"]), np.uint8).astype(np.int32) + 2
    starts = np.cumsum(sizes + 1) - sizes - 1
    t[starts + sizes] = 1
    t[-1] = 0
    sa = suffix_array(t, 258)
    prefix, before = common_prefixes(t, sa, length)
    twice = prefix > 0
    twice[before[twice]] = True
    return [twice[a : a + max(0, n - length + 1)] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


REGION = "h long, r1 long, r2 long, n long, off int, text binary"
VERDICT = "h long, r1 long, r2 long, a int, b int"


def _regions(docs: DataFrame, length: int) -> DataFrame:
    """All regions; docs: id, th, text."""

    def run(batches):
        for batch in chunks(batches):
            batch = batch.filter(pa.array(np.diff(utf8(batch.column("text"))[1]) >= length))
            found = regions(*utf8(batch.column("text")), length)
            row = pa.array(found["row"])
            yield batch_of(id=batch.column("id").take(row), th=batch.column("th").take(row), **{c: pa.array(found[c], pa.int32() if c in ("p", "lo", "hi") else pa.int64()) for c in ("p", "lo", "hi", "h", "r1", "r2")})

    return docs.mapInArrow(run, "id long, th long, p int, lo int, hi int, h long, r1 long, r2 long")


def _texts(need: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes of regions (id, th, p, lo, hi, h, r1, r2, n, d) by their documents."""
    places = need.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi", "p", "h", "r1", "r2", "n", "d")).alias("need"))

    def run(batches):
        for batch in chunks(batches):
            data, offs = utf8(batch.column("text"))
            each = batch.column("need").combine_chunks() if isinstance(batch.column("need"), pa.ChunkedArray) else batch.column("need")
            x, base = each.flatten(), np.repeat(offs[:-1], each.value_lengths().to_numpy())
            lo, hi = x.field("lo").to_numpy(), x.field("hi").to_numpy()
            raw = data.tobytes()
            yield batch_of(**{c: x.field(c) for c in ("h", "r1", "r2", "n", "d")}, off=pa.array(x.field("p").to_numpy() - lo, pa.int32()), text=pa.array([raw[a:b] for a, b in zip((base + lo).tolist(), (base + hi).tolist(), strict=True)], pa.binary()))

    return docs.join(places, ["id", "th"]).select("text", "need").mapInArrow(run, "h long, r1 long, r2 long, n long, d long, off int, text binary")


def _by_shards(found: DataFrame, length: int) -> DataFrame:
    """Windows that repeat, as starts a to b relative to the seed; found: key, REGION, every key's in one shard."""
    size = found.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    shards = max(1, -(-size // SHARD))
    n = max(min(shards, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))), shards // EACH)

    def run(batches):
        for held, cut in whole_runs(batches, ["shard"]):
            for i, j in zip(cut, cut[1:], strict=False):
                some = held.slice(int(i), int(j - i)).combine_chunks()
                texts, single = some.column("text").to_pylist(), (some.column("n").to_numpy() == 1).tolist()
                off, row, a, b = some.column("off").to_pylist(), [], [], []
                for k, flags in enumerate(repeated(texts, length)):
                    for x, y in runs(flags) if single[k] else ():
                        row.append(k)
                        a.append(x - off[k])
                        b.append(y - off[k])
                at = pa.array(row, pa.int32())
                yield batch_of(**{c: some.column(c).combine_chunks().take(at) for c in ("h", "r1", "r2")}, a=pa.array(a, pa.int32()), b=pa.array(b, pa.int32()))

    dealt = found.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return dealt.select("shard", "h", "r1", "r2", "n", "off", "text").repartitionById(n, (F.col("shard") % n).cast("int")).sortWithinPartitions("shard").mapInArrow(run, VERDICT)


def _halves(found: DataFrame, length: int) -> DataFrame:
    """Regions of keys split in two by the windows' distance to the seed, [low, high) to [low, mid) and [mid, high)."""

    def run(batches):
        names = ("h", "r1", "r2", "n", "key", "low", "high", "off", "text", "k1", "k2")
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for r in batch.to_pylist():
                off, text = r["off"], r["text"]
                mid = (r["low"] + r["high"]) // 2
                for low, high in ((r["low"], mid), (mid, r["high"])):
                    # windows start at off - d for low <= d < high, inside the region
                    first, last = max(0, off - high + 1), min(len(text) - length, off - low)
                    if low >= high or first > last:
                        continue
                    core = text[off - high + 1 + (high - 1 - low) : off - high + 1 + length]
                    part = text[first : last + length]
                    k = hashlib.blake2b(core, digest_size=16, key=r["key"].to_bytes(8, "little", signed=True), person=low.to_bytes(4, "little")).digest()
                    q = hashlib.blake2b(part, digest_size=16, person=(off - first).to_bytes(4, "little")).digest()
                    for x, v in zip(out, (r["h"], r["r1"], r["r2"], r["n"], int.from_bytes(k[:8], "little", signed=True), low, high, off - first, part, int.from_bytes(q[:8], "little", signed=True), int.from_bytes(q[8:], "little", signed=True)), strict=True):
                        x.append(v)
            kinds = (pa.int64(),) * 5 + (pa.int32(),) * 3 + (pa.binary(),) + (pa.int64(),) * 2
            yield batch_of(**{c: pa.array(x, k) for c, x, k in zip(names, out, kinds, strict=True)})

    return found.mapInArrow(run, "h long, r1 long, r2 long, n long, key long, low int, high int, off int, text binary, k1 long, k2 long")


def _crowded(found: DataFrame, length: int) -> list[DataFrame]:
    """Verdicts on regions of keys that have too many of them for a shard."""
    far = F.col("off") >= _half(length)
    out, left = [], found.withColumn("key", F.col("h")).withColumn("low", F.when(far, _half(length)).otherwise(0)).withColumn("high", F.when(far, length - SEED + 1).otherwise(_half(length)))
    while not left.isEmpty():
        halves = saved(_halves(left, length))
        same = halves.groupBy("key", "k1", "k2").agg(F.sum("n").alias("m"), F.count("*").alias("c"), F.min(F.struct("h", "r1", "r2")).alias("one"))
        keys = same.groupBy("key").agg(F.count("*").alias("d"))
        marked = halves.join(same, ["key", "k1", "k2"]).join(keys, "key")
        last = F.octet_length("text") - length - F.col("off")
        out.append(marked.where((F.col("m") > 1) & (F.col("n") == 1)).select("h", "r1", "r2", (-F.col("off")).alias("a"), last.alias("b")))
        ones = marked.where((F.col("d") > 1) & (F.struct("h", "r1", "r2") == F.col("one"))).withColumn("n", F.col("m"))
        few = ones.where(F.col("d") <= MOST)
        out.append(_by_shards(few.select("key", *(c.split()[0] for c in REGION.split(", "))), length))
        left = saved(ones.where(F.col("d") > MOST).select("h", "r1", "r2", "n", "key", "low", "high", "off", "text"))
    return out


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, th, and the array `cut` of start and end of stretches that hold only repeated windows; docs: id, th, text."""
    every = saved(_regions(docs, length))
    same = every.groupBy("h", "r1", "r2").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "p", "lo", "hi")).alias("x"))
    keys = same.groupBy("h").agg(F.count("*").alias("d"), F.sum("n").alias("m")).where("m > 1")
    known = saved(same.join(keys, "h").select("h", "r1", "r2", "n", "d", "x.*"))
    whole = known.where("n > 1").select("h", "r1", "r2", (F.col("lo") - F.col("p")).alias("a"), (F.col("hi") - length - F.col("p")).alias("b"))
    found = saved(_texts(known.where("d > 1"), docs))
    few = found.where(F.col("d") <= MOST).withColumn("key", F.col("h"))
    verdict = whole.unionByName(_by_shards(few, length))
    for more in _crowded(found.where(F.col("d") > MOST).drop("d"), length):
        verdict = verdict.unionByName(more)
    verdict = saved(verdict)
    cuts = every.select("id", "th", "p", "h", "r1", "r2").join(verdict, ["h", "r1", "r2"])
    return saved(cuts.groupBy("id", "th").agg(F.collect_set(F.struct((F.col("p") + F.col("a")).alias("s"), (F.col("p") + F.col("b") + length).alias("f"))).alias("cut")))


def merged(cut: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, f in sorted((x["s"], x["f"]) for x in cut):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(f, out[-1][1]))
        else:
            out.append((s, f))
    return out


def report(docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, its bytes, those removed, maximal removed runs, and the hash of the rest."""
    named = docs.select(col(doc_id).cast("long").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    named = named.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("th", F.xxhash64("text"))
    cuts = repeats(named.drop("doc_id"), length)

    def run(batches):
        for batch in chunks(batches):
            data, offs = utf8(batch.column("text"))
            n, removed, spans, kept = np.diff(offs), [], [], []
            for a, b, cut in zip(offs[:-1].tolist(), offs[1:].tolist(), batch.column("cut").to_pylist(), strict=True):
                gone, raw = merged(cut or []), data[a:b].tobytes()
                ends = [0, *(x for s in gone for x in s), b - a]
                removed.append(sum(f - s for s, f in gone))
                spans.append(len(gone))
                kept.append(hashlib.sha256(b"".join(raw[s:f] for s, f in zip(ends[::2], ends[1::2], strict=True))).hexdigest())
            yield batch_of(doc_id=batch.column("doc_id"), n_bytes=pa.array(n, pa.int64()), n_removed=pa.array(removed, pa.int64()), n_spans=pa.array(spans, pa.int64()), kept_sha256=pa.array(kept, pa.string()))

    return named.join(cuts, ["id", "th"], "left").select("doc_id", "text", "cut").mapInArrow(run, SCHEMA)
