"""Nearest neighbours by inner product through cross-polytope hashing.

A hash turns a unit vector by three rounds of random signs and a fast Hadamard transform
and takes the nearest signed axis. A table's bucket is the codes of several such hashes,
the last over fewer axes, so that a bucket has about FILL rows whatever their number. A
query probes in each table the buckets of least total distance: for each hash, how far
the axis is behind the nearest one, squared and summed. The share of rows that this
reaches falls with their number (see probes). What it finds is ranked by its exact inner
product.

Rows are taken by ranges of their norm, each at most a quarter of a power of two wide;
where norms in one differ, vectors get one more coordinate that makes them unit vectors
by the range's largest norm and keeps the order of their inner products with a query. A
query probes all ranges; those of at most FEW rows are ranked whole. Queries that still
found fewer than k rows, with more there, are ranked against all rows in a second pass.

Rows and probes meet in cells, the buckets that share their first bits. A cell of more
than CELL rows or queries is dealt in so many parts, each part of its rows to each of its
queries. Of equal vectors the k + 1 smallest ids go on: no others can be among a query's k
nearest, as ties go to the smaller id. So no task depends on how many rows share a vector
or a bucket, and no row is left out.

Defined cases: vectors that are null, empty, zero or hold a null or a number that is not
finite take no part, nor do rows without an id; vectors of another size than the query's
aren't its neighbours; rows that repeat an id and vector count once, and of several
vectors with one id the best counts; a query's own id is no neighbour; ties go to the
smaller id; fewer candidates than k give them all; further columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, col, saved, whole_runs

#: Tables; rows of a bucket; rows of a range of norms up to which each query is ranked against all of them.
TABLES, FILL, FEW = 12, 2, 1000
#: A query's probes reach this share of REACHED rows, counted once for each table, and of other numbers of rows more or less by FALL.
SHARE, REACHED, FALL = 0.14, 50_000, 0.42
#: Rows or queries of a part of a cell; the most cells that are dealt in parts.
CELL, CELLS = 1 << 15, 10_000
PAIRS = "query_id long, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast transform of rows whose length is a power of two; not scaled."""
    n, size, h = len(x), x.shape[1], 1
    while h < size:
        y = x.reshape(n, -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, size)
        h *= 2
    return x


def bits_for(rows: int) -> int:
    """Bits of a bucket's number; 0: all rows are in one."""
    return 0 if rows <= FEW else max(1, (rows // FILL).bit_length() - 1)


def probes(rows: int, tables: int = TABLES, share: float = SHARE) -> int:
    """Buckets that a query probes in each table."""
    return min(1 << bits_for(rows), max(1, round(share * (REACHED / rows) ** FALL * (1 << bits_for(rows)) / tables)))


@dataclass
class Range:
    """Rows of about one norm: the largest, their number, how far a bucket's number is shifted for its cell's."""

    longest: float
    rows: int

    @property
    def bits(self) -> int:
        return bits_for(self.rows)

    @property
    def shift(self) -> int:
        return max(0, self.bits - (self.rows // CELL).bit_length())


class Hashes:
    def __init__(self, size: int, ranges: dict[int, Range], tables: int = TABLES, share: float = SHARE, level: bool = True):
        """level: whether all norms of each range are about its largest."""
        self.size, self.ranges, self.tables, self.share, self.level = size, ranges, tables, share, level
        self.width = 1 << max(1, (size + (not level) - 1).bit_length())
        self.axes = self.width.bit_length()  # bits of a signed axis
        count = max(1, *(-(-r.bits // self.axes) for r in ranges.values()))
        self.signs = np.random.default_rng(64).choice([-1.0, 1.0], (tables, count, 3, self.width))

    def lift(self, x: np.ndarray, longest: np.ndarray | None = None) -> np.ndarray:
        """Unit vectors of queries, or of rows, given the largest norm of each one's range."""
        out = np.zeros((len(x), self.width))
        norm = np.linalg.norm(x, axis=1)
        out[:, : self.size] = x / (norm if longest is None or self.level else longest)[:, None]
        if not (longest is None or self.level):
            out[:, self.size] = np.sqrt(np.maximum(0, 1 - (norm / longest) ** 2))
        return out

    def turned(self, x: np.ndarray, table: int, bits: int) -> list[np.ndarray]:
        """By hash of a bucket the products with its signed axes."""
        out = []
        for k, left in enumerate(range(bits, 0, -self.axes)):
            y = x
            for signs in self.signs[table, k]:
                y = hadamard(y * signs) / self.width**0.5
            y = y[:, : 1 << min(left, self.axes) - 1]
            out.append(np.concatenate([y, -y], 1))
        return out

    def codes(self, x: np.ndarray, number: int) -> np.ndarray:
        """Rows' buckets [row, table] in the range of that number."""
        own = self.ranges[number]
        if not own.bits:
            return np.zeros((len(x), 1), np.int64)
        out, lifted = np.zeros((len(x), self.tables), np.int64), self.lift(x, np.full(len(x), own.longest))
        for t in range(self.tables):
            for y in self.turned(lifted, t, own.bits):
                out[:, t] = out[:, t] * y.shape[1] + y.argmax(1)
        return out

    def probed(self, x: np.ndarray, number: int) -> np.ndarray:
        """Queries' buckets [query, table, probe]: the ones of least distance among all combinations."""
        own = self.ranges[number]
        if not own.bits:
            return np.zeros((len(x), 1, 1), np.int64)
        n, lifted = probes(own.rows, self.tables, self.share), self.lift(x)
        out = np.zeros((len(x), self.tables, n), np.int64)
        for t in range(self.tables):
            code, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
            for y in self.turned(lifted, t, own.bits):
                # a bucket among the best begins with one among the best beginnings
                behind = (y.max(1, keepdims=True) - y) ** 2
                cost = (cost[:, :, None] + behind[:, None, :]).reshape(len(x), -1)
                code = (code[:, :, None] * y.shape[1] + np.arange(y.shape[1])).reshape(len(x), -1)
                if cost.shape[1] > n:
                    best = np.argpartition(cost, n - 1, 1)[:, :n]
                    cost, code = np.take_along_axis(cost, best, 1), np.take_along_axis(code, best, 1)
            out[:, t] = code
        return out


def best_of(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k best, each id once."""
    order = np.lexsort((-score, ids, q))  # an id's best comes first
    q, ids, score = q[order], ids[order], score[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
    q, ids, score = q[new], ids[new], score[new]
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return q[rank < k], ids[rank < k], score[rank < k]


def usable(rows: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """vec_id, v, norm and its range of the rows that take part, each once."""
    kind = rows.schema[vector].dataType.elementType
    v = col(vector) if isinstance(kind, T.FloatType) else F.transform(col(vector), lambda x: x.cast("double"))
    out = rows.select(col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    out = out.where(~bad).withColumn("norm", norm).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    return out.distinct().withColumn("range", F.floor(4 * F.log2("norm") + 0.5).cast("int"))


def matrix(vectors, size: int) -> np.ndarray:
    flat = vectors.combine_chunks().flatten() if isinstance(vectors, pa.ChunkedArray) else vectors.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _places(good: DataFrame, hashes: Hashes, asked: bool) -> DataFrame:
    """vec_id, v, and where it belongs: keys of cells and codes in them (one of a row, all that a query probes)."""
    kind = good.schema["v"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x, ranges = matrix(batch.column("v"), hashes.size), batch.column("range").to_numpy()
            for number, own in sorted(hashes.ranges.items()):
                at = np.arange(len(x)) if asked else np.flatnonzero(ranges == number)
                for a in range(0, len(at), 256 if asked else 4096):
                    some = at[a : a + (256 if asked else 4096)]
                    codes = hashes.probed(x[some], number) if asked else hashes.codes(x[some], number)[:, :, None]
                    row = np.repeat(some, codes.shape[1] * codes.shape[2])
                    table = np.tile(np.repeat(np.arange(codes.shape[1]), codes.shape[2]), len(some))
                    code = codes.ravel()
                    key = (((number + (1 << 20)) << 42) | (table << 36)) + (code >> own.shift)
                    order = np.lexsort((code, key, row))
                    row, key, code = row[order], key[order], code[order]
                    cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])) if len(row) else np.zeros(0, np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(row)), pa.int32()), pa.array(code))
                    cells = pa.StructArray.from_arrays([pa.array(key[cut], pa.int64()), lists], ["key", "codes"])
                    ends = np.searchsorted(row[cut], some, "right")
                    which = pa.array(some)
                    yield batch_of(vec_id=batch.column("vec_id").take(which), v=batch.column("v").take(which), cells=pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), cells))

    return good.mapInArrow(run, f"vec_id long, v {kind}, cells array<struct<key:long,codes:array<long>>>")


def _ranked(rows: DataFrame, asked: DataFrame, hashes: Hashes, k: int) -> DataFrame:
    """PAIRS: of each query the k best of the rows that it meets, and perhaps some more."""
    each = [saved(_places(rows, hashes, False)), saved(_places(asked, hashes, True))]
    posts, probed = (x.select("vec_id", "v", F.explode("cells").alias("cell")).select("vec_id", "v", "cell.*") for x in each)
    counts = posts.groupBy("key").agg(F.count("*").alias("r")).join(probed.groupBy("key").agg(F.count("*").alias("q")), "key")
    limit = max(CELL, -(-posts.count() // CELLS), -(-probed.count() // CELLS))  # so that at most 2 * CELLS are larger
    hot = F.broadcast(counts.where(F.greatest("r", "q") > limit).select("key", F.ceil(F.col("r") / limit).alias("rs"), F.ceil(F.col("q") / limit).alias("qs")))

    def dealt(of: DataFrame, own: str, other: str, kind: int) -> DataFrame:
        named = of.join(hot, "key", "left").withColumn("rs", F.coalesce("rs", F.lit(1))).withColumn("qs", F.coalesce("qs", F.lit(1)))
        part: Column = F.pmod(F.xxhash64("vec_id"), F.col(own))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        i, j = (part, every) if own == "rs" else (every, part)
        return named.select("key", i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"), "vec_id", "v", "codes")

    size, n = hashes.size, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        found = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        for held, cut in whole_runs(batches, ["key", "i", "j"]):
            kind, ids = held.column("kind").to_numpy(), held.column("vec_id").to_numpy()
            parts = [found]
            for a, b in zip(cut.tolist(), cut.tolist()[1:], strict=False):
                split = a + int(np.searchsorted(kind[a:b], 1))
                if a < split < b:
                    parts += _met(held.slice(a, split - a), held.slice(split, b - split), ids[a:split], ids[split:b], size, k)
            found = best_of(*(np.concatenate(x) for x in zip(*parts, strict=True)), k)
            if len(found[0]) > 1_000_000:
                yield batch_of(query_id=pa.array(found[0]), vec_id=pa.array(found[1]), score=pa.array(found[2]))
                found = tuple(x[:0] for x in found)
        yield batch_of(query_id=pa.array(found[0]), vec_id=pa.array(found[1]), score=pa.array(found[2]))

    both = dealt(posts, "rs", "qs", 0).unionByName(dealt(probed, "qs", "rs", 1))
    return both.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "kind").mapInArrow(run, PAIRS)


def _met(rows: pa.Table, asked: pa.Table, ids: np.ndarray, q: np.ndarray, size: int, k: int) -> list[tuple]:
    """(query, id, score) arrays of the pairs that meet in a bucket, the k best of each query and bunch of pairs."""
    x, y = matrix(rows.column("v"), size), matrix(asked.column("v"), size)
    code = rows.column("codes").combine_chunks().flatten().to_numpy()
    order = np.argsort(code, kind="stable")
    code = code[order]
    lists = asked.column("codes").combine_chunks()
    probe, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
    lo = np.searchsorted(code, probe)
    many = np.searchsorted(code, probe, "right") - lo
    ends, out, at = np.cumsum(many), [], 0
    while at < len(probe):
        base = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + 50_000, "right")))
        some = many[at:stop]
        which = np.repeat(who[at:stop], some)
        row = order[np.repeat(lo[at:stop] + some - ends[at:stop], some) + np.arange(base, base + len(which))]
        at = stop
        for a in range(0, len(row), 50_000):  # one bucket may be larger
            w, r = which[a : a + 50_000], row[a : a + 50_000]
            other = q[w] != ids[r]
            w, r = w[other], r[other]
            out.append(best_of(q[w], ids[r], (y[w] * x[r]).sum(1), k))
    return out


def search(rows: DataFrame, k: int = 20, every: int = 20, vector: str = "embedding", vec_id: str = "vec_id", tables: int = TABLES, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose id is divisible by `every`, the k nearest found among all others."""
    good = usable(rows, vector, vec_id)
    asked = saved(good.where(F.col("vec_id") % every == 0))
    same = Window.partitionBy("v").orderBy("vec_id")
    good = saved(good.withColumn("same", F.row_number().over(same)).where(F.col("same") <= k + 1).drop("same"))
    kinds = good.groupBy(F.size("v").alias("size"), "range").agg(F.max("norm").alias("hi"), F.min("norm").alias("lo"), F.count("*").alias("rows")).collect()
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def passes(asked: DataFrame, exact: bool) -> DataFrame:
        found = rows.sparkSession.createDataFrame([], PAIRS)
        for size in sorted({r["size"] for r in kinds}):
            mine = [r for r in kinds if r["size"] == size]
            level = all(r.hi - r.lo <= 1e-3 * r.hi for r in mine if r.rows > FEW)
            hashes = Hashes(size, {r["range"]: Range(r.hi, 0 if exact else r.rows) for r in mine}, tables, share, level)
            found = found.unionByName(_ranked(good.where(F.size("v") == size), asked.where(F.size("v") == size), hashes, k))
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return best.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)

    out = saved(passes(asked, False))
    # each size's other rows: of a query that found fewer than k, or than there are, all are ranked
    there = good.groupBy(F.size("v").alias("size")).agg((F.count_distinct("vec_id") - 1).alias("others"))
    met = out.groupBy("query_id").agg(F.count("*").alias("met"))
    may = asked.select("vec_id", F.size("v").alias("size")).distinct().join(there, "size").groupBy("vec_id").agg(F.sum("others").alias("others"))
    short = saved(may.join(met, may.vec_id == met.query_id, "left").where(F.coalesce("met", F.lit(0)) < F.least(F.lit(k), "others")).select("vec_id"))
    if not short.isEmpty():
        out = out.join(short, out.query_id == short.vec_id, "left_anti").unionByName(passes(asked.join(short, "vec_id"), True))
    return out.select("query_id", "rank", "vec_id", "score")
