"""Shared pieces: Arrow text buffers, vectorised words, hashing, batching, shared storage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Text bytes handled at once by the vectorised scanners; a longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names: others may clash with an operator's own."""
    return df.select([col(source).alias(name) for name, source in columns.items()])


def saved(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept in the shared folder of spark.checkpoint.dir."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="sourcemark-")
        context.setCheckpointDir(shared)
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(_CLEAN, "false")
    conf.set(_CLEAN, "true")  # the frame's own shuffles go with its last task
    try:
        return df.select("*").checkpoint()
    finally:
        conf.set(_CLEAN, before)


def dropped(*frames: DataFrame) -> None:
    """Deletes the files of saved frames that nothing will read again."""
    for df in frames:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            jvm = df.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(df: DataFrame, rows_each: int, rows: int) -> int:
    """Enough partitions for so many rows each, the session's number at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def crc_mod(id_column: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % mod


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix64's finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; those for a chunk are kept, longer ones made anew."""
    kept = _powers.get(base, ())
    if len(kept) >= n:
        return kept[:n]
    x = np.full(max(n, 1 << 16), base, np.uint64)
    x[0] = 1
    x = np.cumprod(x, dtype=np.uint64)
    if len(x) <= CHUNK_BYTES + 1:
        _powers[base] = x
    return x[:n]


def prefix_hash(data: np.ndarray, lut: np.ndarray = _BYTE) -> np.ndarray:
    """Sums s with s[j] - s[i] = hash of data[i:j] times base**i."""
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(lut[data] * powers(len(data)), dtype=np.uint64, out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], the same wherever the bytes stand."""
    top = int(start.max()) + 1 if len(start) else 1
    return mix((s[end] - s[start]) * powers(top, _INVERSE)[start])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the rows' offsets in them; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def chunks(batches: Iterable[pa.RecordBatch], text: str | None = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """A task's rows in batches of at most so many text bytes, or of one row."""
    try:
        yield from parted(batches, text, limit)
    finally:
        tidied()


def parted(batches: Iterable[pa.RecordBatch], text: str | None = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(utf8(batch.column(text))[1]) + 64
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def tidied() -> None:
    """A worker goes on to other tasks: what this one needed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of a batch of texts: byte spans, rows and 64-bit hashes.

    Hashes take A-Z as a-z if lower is set. Row r has the words first[r]:first[r+1].
    With between, the bytes that part words are those where it is true.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = True, between: np.ndarray = _SEP):
        self.data, self.offs = data, offs
        inside = ~between[data]
        begin, finish = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        finish[:-1] &= ~inside[1:]
        edge = offs[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        begin[edge] = inside[edge]
        finish[edge - 1] = inside[edge - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.start, offs)
        self.hash = np.empty(len(self.start), np.uint64)
        lut, at = _LOWER if lower else _BYTE, 0
        while at < len(self.start):
            base = int(self.start[at])
            stop = max(at + 1, int(np.searchsorted(self.end, base + CHUNK_BYTES, "right")))
            last = int(self.end[stop - 1])
            s = prefix_hash(data[base:last], lut)
            self.hash[at:stop] = span_hash(s, self.start[at:stop] - base, self.end[at:stop] - base)
            at = stop

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), np.diff(self.first))

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


class WordTable:
    """Rows of numbers by word hash, worked out once a distinct word; at most `limit` are kept."""

    def __init__(self, width: int, rows_of: Callable[[list[str]], np.ndarray], limit: int = 300_000):
        self.width, self.rows_of, self.limit = width, rows_of, limit
        self.at: dict[int, int] = {}
        self.rows = np.zeros((0, width), np.float32)

    def index(self, w: Words) -> np.ndarray:
        """For each word its row in self.rows."""
        distinct, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.at) > self.limit:
            self.at, self.rows = {}, np.zeros((0, self.width), np.float32)
        keys = distinct.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.at]
        if new:
            made = self.rows_of([w.text(first[i]) for i in new]).astype(np.float32)
            self.at.update(zip((keys[i] for i in new), range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, made])
        return np.fromiter((self.at[k] for k in keys), np.int64, len(keys))[inverse]


def code_points(data: np.ndarray) -> np.ndarray:
    """For each byte offset the number of code points before it (one more entry than bytes)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def kept_rows(docs: DataFrame, text: str, keep: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """The rows for whose texts the function that keep() makes, once a task, says true; all columns as they were, whatever their names."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index(text)]
    plain = docs.toDF(*names)

    def run(batches):
        says = keep()
        for batch in chunks(batches, at):
            yield batch.filter(pa.array(says(batch.column(at)), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def whole_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From rows sorted by keys (64-bit numbers): tables of whole runs of equal keys, and where in them runs begin, with the end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([*held, batch])
        cut = _begins(whole, keys)
        if len(cut) > 2:
            yield whole.slice(0, int(cut[-2])), cut[:-1]
        held = whole.slice(int(cut[-2])).combine_chunks().to_batches()
    if held:
        whole = pa.Table.from_batches(held)
        yield whole, _begins(whole, keys)


def _begins(rows: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows + 1, bool)
    new[[0, -1]] = True
    for k in keys:
        x = rows.column(k).to_numpy()
        new[1:-1] |= x[1:] != x[:-1]
    return np.flatnonzero(new)
