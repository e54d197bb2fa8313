"""Near-duplicate groups by an inverted join over the coordinates of MinHash signatures.

A document's set is its distinct shingles of `words` words. Its signature has COORDS
minima; two documents collide in a coordinate if they have the same value there. Pairs
that collide `need` times are candidates: one of the least similarity fails that with a
chance of MISS. Steps:

1. Equal sets are one class; only its smallest document goes on.
2. Every coordinate-value pair has a global rank, by its count (the bit length of a count
   over SLOTS slots, a table of fixed size) and its key. A class is posted under the
   COORDS - need + 1 first of its pairs: two classes that collide `need` times share one
   of these, whatever the order, and by this one frequent pairs have no long lists.
3. Each posting list links its smallest member to the others: linear in the list,
   whatever its size. Collisions of these pairs are counted over all coordinates (those
   not posted are looked up, never merged), and candidates are confirmed on the full
   sets; the confirmed ones give components.
4. Lists that still hold several components are merged, in blocks by set size, for the
   pairs across components: members of other sizes than a pair may have and of the same
   component are skipped, collisions of the rest counted, and each pair is retained in
   the first list that it shares. Only members go on, with whom they met; their sets come
   together by list and block, and pairs are confirmed until they join nothing new:
   members of one component need no further pair, and only links that join components
   come out.

So a pair is lost only where its signature fails (MISS) and no path of other links joins
it.

Defined cases: null and empty texts have the empty set and link with nothing; a text of
fewer words is one shingle; a null id is linked with nothing, has a null component and
is kept; repeated rows with one id are one document as to links; further columns are
ignored (groups) or kept as they were (one_each). An empty table gives no rows.
"""

from __future__ import annotations

from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, batch_of, chunks, col, dropped, mix, parted, powers, saved, utf8, whole_runs

COORDS, MISS = 128, 1e-6
#: Counts of coordinate-value pairs are kept in so many slots, in rows of so many.
SLOTS, SLOT_ROW = 1 << 20, 256
#: A list is compared in blocks of so many members.
BLOCK = 256
#: Pairs of one document that are confirmed together.
PART = 128
#: Pointers to one member are followed in so many parts.
SALTS = 16
_P = 0xC2B2AE3D27D4EB4F
_rng = np.random.default_rng(8)
_FACTORS = _rng.integers(0, 2**32, COORDS, dtype=np.uint32) | np.uint32(1)
_TERMS = _rng.integers(0, 2**32, COORDS, dtype=np.uint32)


def matches_needed(percent: int) -> int:
    """The most minima in which pairs of that similarity match but for a chance of MISS."""
    p, below = min(1 - 1e-9, percent / 100), 0.0
    for k in range(COORDS):
        below += exp(lgamma(COORDS + 1) - lgamma(k + 1) - lgamma(COORDS - k + 1) + k * log(p) + (COORDS - k) * log(1 - p))
        if below > MISS:
            return max(1, k)
    return COORDS


def prefix_length(need: int) -> int:
    """Pairs of a signature, first in any global order, of which two that collide `need` times share one."""
    return COORDS - need + 1


def shingle_sets(texts: pa.Array, words: int = 5) -> list[np.ndarray]:
    """Per text the sorted hashes of its distinct shingles."""
    w = Words(*utf8(texts))
    counts = np.diff(w.first)
    left = w.first[1:][w.row] - np.arange(len(w.hash))
    size, total = np.minimum(counts[w.row], words), np.zeros(len(w.hash), np.uint64)
    p = powers(words, _P)
    for j in range(words):
        at = np.flatnonzero((j < size) & (j < left))
        total[at] += w.hash[at + j] * p[j]
    h = mix(total + size.astype(np.uint64) * U64(_P))
    return [np.unique(h[a : b - min(n, words) + 1]) if n else h[:0] for a, b, n in zip(w.first[:-1].tolist(), w.first[1:].tolist(), counts.tolist(), strict=True)]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of shingles, which are not empty."""
    x, low = (shingles ^ (shingles >> U64(32))).astype(np.uint32), np.full(COORDS, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 256):
        h = x[None, i : i + 256] * _FACTORS[:, None] + _TERMS[:, None]
        h ^= h >> np.uint32(15)
        np.minimum(low, h.min(1), out=low)
    return low


def signatures(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (hashes of the whole set) and minima of every row; docs: doc_id, text."""

    def run(batches):
        for batch in chunks(batches):
            sets = shingle_sets(batch.column("text"), words)
            k1 = [int(np.add.reduce(mix(s)).view(np.int64)) if len(s) else None for s in sets]
            k2 = [int(np.bitwise_xor.reduce(mix(s + U64(_P))).view(np.int64)) if len(s) else None for s in sets]
            minima = pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())
            yield batch_of(doc_id=batch.column("doc_id"), n_shingles=pa.array([len(s) for s in sets], pa.int64()), k1=pa.array(k1, pa.int64()), k2=pa.array(k2, pa.int64()), minima=minima)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, minima binary")


def coordinate_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of minima: the values, a key of each coordinate-value pair (one to one) and the pair's slot."""
    values = np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDS)
    keys = mix(values.astype(np.uint64) + (np.arange(COORDS, dtype=np.uint64) << U64(32)))
    return values, keys, (keys >> U64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def ranks(classes: DataFrame) -> np.ndarray:
    """For each slot the bit length of how many coordinate-value pairs of the classes fall in it: SLOTS bytes, however many classes there are."""
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def counted(batches):
        held = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            if batch.num_rows:
                held += np.bincount(coordinate_values(batch.column("minima"))[2].ravel(), minlength=SLOTS).astype(np.uint32)
        rows = held.reshape(-1, SLOT_ROW)
        at = np.flatnonzero(rows.any(1))
        yield batch_of(row=pa.array(at, pa.int64()), counts=pa.array([rows[i].tobytes() for i in at], pa.binary()))

    def summed(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, counts in zip(batch.column("row").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                held[row] = held.get(row, 0) + np.frombuffer(counts, np.uint32).astype(np.int64)
        lengths = [np.frexp(x.astype(float))[1].astype(np.uint8).tobytes() for x in held.values()]
        yield batch_of(row=pa.array(list(held), pa.int64()), lengths=pa.array(lengths, pa.binary()))

    sums = classes.select("minima").mapInArrow(counted, "row long, counts binary").repartition(n, "row").mapInArrow(summed, "row long, lengths binary")
    out = np.zeros((SLOTS // SLOT_ROW, SLOT_ROW), np.uint8)
    for row, lengths in sums.collect():  # SLOTS / SLOT_ROW rows at most
        out[row] = np.frombuffer(lengths, np.uint8)
    return out.reshape(-1)


def prefixes(classes: DataFrame, rank: np.ndarray, posted: int) -> DataFrame:
    """The classes with the keys of their `posted` pairs of the least ranks, ascending, and a byte of each minimum as sketch."""
    shared = classes.sparkSession.sparkContext.broadcast(rank.tobytes())

    def run(batches):
        rank = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            values, keys, slots = coordinate_values(batch.column("minima"))
            first = np.lexsort((keys, rank[slots]))[:, :posted]
            # ascending as 64-bit numbers without sign: the order in which a pair's first list is looked for
            kept = np.sort(np.take_along_axis(keys, first, 1)).view(np.int64)
            ends = np.arange(0, kept.size + 1, posted, dtype=np.int32)
            sketch = (values * np.uint32(2654435769) >> np.uint32(24)).astype(np.uint8)
            held = {c: batch.column(c) for c in ("k1", "k2", "doc_id", "n_shingles")}
            yield batch_of(**held, keys=pa.ListArray.from_arrays(pa.array(ends), pa.array(kept.ravel())), sketch=pa.array([x.tobytes() for x in sketch], pa.binary()))

    return classes.mapInArrow(run, "k1 long, k2 long, doc_id long, n_shingles long, keys array<long>, sketch binary")


def sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDS)


def matching(pairs: DataFrame, need: int) -> DataFrame:
    """a, b of the pairs whose sketches (x, y) collide in `need` coordinates."""

    def run(batches):
        for batch in batches:
            same = (sketches(batch.column("x")) == sketches(batch.column("y"))).sum(1) >= need
            yield batch.select(["a", "b"]).filter(pa.array(same))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, words: int = 5) -> DataFrame:
    """a, b of the pairs whose sets have 100 * intersection >= percent * union; docs: doc_id, text.

    Pairs of one a are dealt to parts of about PART, each with a's text.
    """
    count = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = pairs.join(count, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), F.col("b").alias("id"))
    centres = count.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("id"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = dealt.union(centres).join(docs.select(F.col("doc_id").alias("id"), "text"), "id")

    def run(batches):
        for held, cut in whole_runs(batches, ["a", "part"]):
            for i, j in zip(cut, cut[1:], strict=False):
                a, ids = held.column("a")[i].as_py(), held.column("id")[i:j].to_pylist()
                sets: list[np.ndarray] = []
                for some in parted(held.select(["text"]).slice(i, j - i).combine_chunks().to_batches()):
                    sets += shingle_sets(some.column("text"), words)
                centre = [s for x, s in zip(ids, sets, strict=True) if x == a]
                ok = sorted({x for x, s in zip(ids, sets, strict=True) if x != a and any(linked(s, c, percent) for c in centre)})
                yield batch_of(a=pa.array([a] * len(ok), pa.int64()), b=pa.array(ok, pa.int64()))

    return texts.select("a", "part", "id", "text").repartition(n, "a", "part").sortWithinPartitions("a", "part").mapInArrow(run, "a long, b long")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = int((y[at] == x).sum())
    return 100 * same >= percent * (len(x) + len(y) - same)


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of the ids in edges a, b: each id points to the least it has met, and pointers are followed until none moves."""
    edges = saved(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct())
    at = saved(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("to")))
    while True:
        # the least pointer among a member's neighbours, for it and for what it points to
        seen = edges.join(at.toDF("y", "far"), "y").groupBy("x").agg(F.min("far").alias("far"))
        near = at.join(seen, "x").select("x", "to", F.least("to", "far").alias("new"))
        hook = near.groupBy(F.col("to").alias("x")).agg(F.min("new").alias("hook"))
        step = near.join(hook, "x", "left").select("x", "to", F.least("new", F.coalesce("hook", "new")).alias("new"))
        # all members of a large component point to one: each has SALTS places to look that up
        jump = step.select(F.col("x").alias("new"), F.col("new").alias("next")).join(step.select("new").distinct(), "new")
        jump = jump.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        step = step.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int"))
        step = saved(step.join(jump, ["new", "salt"], "left").select("x", "to", F.least("new", F.coalesce("next", "new")).alias("new")))
        moved = step.where(F.col("new") != F.col("to")).limit(1).count()
        at = step.select("x", F.col("new").alias("to"))
        if not moved:
            return at.toDF("id", "component")


def across(lists: DataFrame, need: int, percent: int) -> DataFrame:
    """Members of lists that collide with others of other components `need` times, and whose first common list it is: key, place, id, component, met (ids of the others, each pair with one of its two); lists: key, n (the list's size), id, component, size, keys, sketch."""
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    # every two blocks of a list meet in one place: block i goes to (i, j) and (j, i), ordered, for all j
    places = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.least(own, j).cast("long") * F.lit(1 << 32) + F.greatest(own, j))
    dealt = lists.select("key", "id", "component", "size", "keys", "sketch", own.alias("own"), F.explode(places).alias("place"))
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for held, cut in whole_runs(batches, ["key", "place"]):
            ids, comp, own, size, key, place = (held.column(c).to_numpy() for c in ("id", "component", "own", "size", "key", "place"))
            keys, sketch = held.column("keys").combine_chunks().flatten().to_numpy().reshape(len(ids), -1), sketches(held.column("sketch"))
            seen, met, n_met = np.zeros(len(ids), bool), {}, 0

            def told(seen=seen, met=met, key=key, place=place, ids=ids, comp=comp):
                at = np.flatnonzero(seen)
                values = [met.get(x, ids[:0]) for x in at.tolist()]
                ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([ids[:0], *values])))
                seen[:] = False
                met.clear()
                return batch_of(key=pa.array(key[at]), place=pa.array(place[at]), id=pa.array(ids[at]), component=pa.array(comp[at]), met=lists)

            for i, j in zip(cut.tolist(), cut.tolist()[1:], strict=False):
                order = i + np.lexsort((ids[i:j], size[i:j], own[i:j]))
                c, s, o, z = comp[order], sketch[order], own[order], size[order]
                split = int(np.searchsorted(o, o[0], "right"))
                # each block ascends by size: what is too small or too large is skipped whole
                start = np.arange(1, split + 1) if split == len(order) else split + np.searchsorted(z[split:], -(-percent * z[:split] // 100))
                stop = (split if split < len(order) else 0) + np.searchsorted(z[split:] if split < len(order) else z, 100 * z[:split] // percent, "right")
                for k in range(split):
                    rest = start[k] + np.flatnonzero(c[start[k] : stop[k]] != c[k])
                    rest = rest[(s[rest] == s[k]).sum(1) >= need] if len(rest) else rest
                    if len(rest):
                        both = keys[order[rest]]
                        first = np.isin(both, keys[order[k]]).argmax(1)
                        rest = order[rest[both[np.arange(len(rest)), first] == key[i]]]
                        if len(rest):
                            met[int(order[k])] = ids[rest]
                            seen[order[k]], seen[rest] = True, True
                            n_met += len(rest)
                if n_met > 50_000:  # never many pairs at once
                    yield told()
                    n_met = 0
            yield told()

    return dealt.repartition(n, "key", "place").sortWithinPartitions("key", "place").mapInArrow(run, "key long, place long, id long, component long, met array<long>")


def linking(found: DataFrame, docs: DataFrame, percent: int, words: int = 5) -> DataFrame:
    """Links a, b, confirmed on full sets, that join the components of `found` (of across); each text goes once to each place of its own."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = found.join(docs.select(F.col("doc_id").alias("id"), "text"), "id").select("key", "place", "id", "component", "met", "text")

    def run(batches):
        for held, cut in whole_runs(batches, ["key", "place"]):
            a, b = [], []
            for i, j in zip(cut.tolist(), cut.tolist()[1:], strict=False):
                some = held.slice(i, j - i).combine_chunks()
                ids, comp, met = (some.column(c).to_pylist() for c in ("id", "component", "met"))
                sets: list[np.ndarray] = []
                for part in parted(some.select(["text"]).to_batches()):
                    sets += shingle_sets(part.column("text"), words)
                at: dict[int, list[int]] = {}
                for k, x in enumerate(ids):
                    at.setdefault(x, []).append(k)
                up: dict[int, int] = {}

                def root(c, up=up):
                    while c in up:
                        c = up[c]
                    return c

                for k, others in enumerate(met):
                    for y in others:
                        p, q = root(comp[k]), root(comp[at[y][0]])
                        # what other links have joined by now needs none
                        if p != q and any(linked(sets[k], sets[m], percent) for m in at[y]):
                            up[max(p, q)] = min(p, q)
                            a.append(min(ids[k], y))
                            b.append(max(ids[k], y))
            yield batch_of(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))

    return texts.repartition(n, "key", "place").sortWithinPartitions("key", "place").mapInArrow(run, "a long, b long")


def members(docs: DataFrame, percent: int, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; docs: doc_id, text."""
    need = matches_needed(percent)
    sigs = saved(signatures(docs, words))
    real = sigs.where(F.col("k1").isNotNull() & F.col("doc_id").isNotNull())
    # equal sets are one class, under its smallest document
    best = F.min(F.struct("doc_id", "n_shingles", "minima"))
    distinct = saved(real.groupBy("k1", "k2").agg(best.alias("m")).select("k1", "k2", "m.*"))
    classes = saved(prefixes(distinct, ranks(distinct), prefix_length(need)))
    dropped(distinct)
    posts = classes.select("doc_id", F.explode("keys").alias("key"))
    least = posts.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").drop("z")
    star = posts.join(least, "key").where(F.col("a") < F.col("doc_id")).select("a", F.col("doc_id").alias("b")).distinct()
    sketch = classes.select("doc_id", "sketch")
    star = saved(matching(star.join(sketch.toDF("b", "y"), "b").join(sketch.toDF("a", "x"), "a"), need))
    links = saved(confirmed(star, docs, percent, words))
    group = saved(components(links))
    lists = posts.join(group, posts.doc_id == group.id, "left").select("key", F.col("doc_id").alias("id"), F.coalesce("component", "doc_id").alias("component"))
    mixed = lists.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
    whole = classes.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), "keys", "sketch")
    more = saved(across(lists.join(mixed, "key").join(whole, "id"), need, percent))
    if not more.isEmpty():
        more = saved(linking(more, docs, percent, words))
        group = saved(components(links.union(more)))
    label = classes.join(group.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("k1", "k2", F.coalesce("component", "doc_id").alias("c"))
    return sigs.join(label, ["k1", "k2"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))


def groups(docs: DataFrame, percent: int = 80, words: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    out = members(docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text")), percent, words)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_each(docs: DataFrame, percent: int = 80, words: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows whose document is the smallest of its group, all their columns as they were."""
    other = "_" + max(docs.columns, key=len)  # no column of docs has that name
    gone = groups(docs, percent, words, text, doc_id).where(~F.col("kept")).select(F.col("doc_id").alias(other)).distinct()
    return docs.join(gone, col(doc_id).cast("long") == col(other), "left_anti")
