"""Best-fit packing of token sequences, with a second look at each bin's smallest piece.

A document's ids, closed by END, are cut into pieces of `size` ids if there are more
(the first may be shorter). A bin takes the longest piece left, then again and again
the longest that fits; last, if two pieces left fit the gap that its smallest piece
would leave more tightly than that piece does, they take its place.

Pieces are dealt by row number to groups of about GROUP pieces, each packed on its
own, so that no task holds more, at the price of at most one loose bin a group.

Defined cases: a null text is empty and has the one id END; a special token's string in
a text is that token, as the vocabulary's library has it; a text of any length is encoded
whole; pieces of equal length are taken in any order; a null id stays null; repeated rows
are documents of their own; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, chunks, col, saved, utf8

SIZE, END, GROUP = 1024, 2, 20_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: White space in UTF-8: bytes that are one by themselves, and sequences. Then characters that are white space in some versions of Unicode only.
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BLANKS = [chr(c).encode() for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: Characters that may be letters of one token: ASCII's and Latin-1's. A unit of them with or without a space before it is one token.
_ASCII = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_PLAIN = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_UNSURE = [chr(c).encode() for c in (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0x180E)]


_LETTERS = [bytes([0xC3, c]) for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]


def byte_letters() -> list[str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def places(data: np.ndarray, sequences: list[bytes]) -> np.ndarray:
    """Where any of the sequences (up to three bytes, as many for each first byte) begins."""
    out = []
    for lead in {s[0] for s in sequences}:
        at = np.flatnonzero(data == lead)
        size = max(len(s) for s in sequences if s[0] == lead)
        at = at[at + size <= len(data)]
        second = np.isin(np.arange(256), [s[1] for s in sequences if s[0] == lead and size > 1])
        at = at[second[data[at + 1]]] if size > 1 else at
        if size > 2:
            ok = np.zeros(len(at), bool)
            for s in (s for s in sequences if s[0] == lead):
                ok |= (data[at + 1] == s[1]) & (data[at + 2] == s[2])
            at = at[ok]
        out.append(at)
    return np.concatenate(out)


def stretches(data: np.ndarray, offs: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Where stretches that can be encoded on their own begin in texts that lie one after another, with the end.

    They begin at texts, at white space behind other characters, as a token that holds
    other characters ends before white space, between letters and stops, at letters behind
    a single line end, and at both ends of a special token. Texts with a character that is
    white space in some versions only are parted at special tokens alone.
    """
    blank = _BLANK[data]
    for size in (2, 3):
        at = places(data, [s for s in _BLANKS if len(s) == size])
        for k in range(size):
            blank[at + k] = True
    begin = np.zeros(len(data) + 1, bool)
    begin[1:-1] = blank[1:] & ~blank[:-1]
    begin[offs] = True
    opens, closes = _ASCII[data], _ASCII[data]  # letters' first and last bytes
    at = places(data, _LETTERS)
    opens[at], closes[at + 1] = True, True
    stop = (data == 46) | (data == 44)
    begin[1:-1] |= (closes[:-1] & stop[1:]) | (stop[:-1] & opens[1:]) | ((data[:-1] == 10) & begin[:-2] & opens[1:])
    unsure = np.unique(np.searchsorted(offs, places(data, _UNSURE), "right") - 1)
    for i in unsure.tolist():
        begin[offs[i] : offs[i + 1]] = False
    begin[offs] = True
    raw = data.tobytes() if special else b""
    for s in special:
        at = raw.find(s)
        while at >= 0:
            i = int(np.searchsorted(offs, at, "right"))
            if at + len(s) <= offs[i]:  # in one text
                begin[[at, at + len(s)]] = True
            at = raw.find(s, at + 1)
    return np.flatnonzero(begin)


@functools.lru_cache(1)
def tokenizer(file: str):
    """The vocabulary, read once a process; what it has encoded is kept by a task's encoder only."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


class Encoder:
    """Ids of texts, by stretches, each distinct one encoded once; at most `limit` are kept."""

    def __init__(self, tokenizer_file: str, limit: int = 300_000):
        self.model, self.limit = tokenizer(tokenizer_file), limit
        self.special = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        self.bpe, self.letters = self.model.model, byte_letters()
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def slots(self, distinct: list[str]) -> np.ndarray:
        """For each text its place in self.first."""
        if len(self.at) > self.limit:
            self.forget()
        words, others = [], []
        for s in itertools.filterfalse(self.at.__contains__, distinct):
            (words if _PLAIN.fullmatch(s) else others).append(s)
        tokens = [self.bpe.tokenize("".join([self.letters[b] for b in s.encode()])) for s in words]
        ids = [[x.id for x in t] for t in tokens]
        for i in range(0, len(others), 10_000):
            ids += [e.ids for e in self.model.encode_batch_fast(others[i : i + 10_000], add_special_tokens=False)]
        if ids:
            self.at.update(zip(words + others, itertools.count(len(self.at))))
            self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.uint32)])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(x) for x in ids])])
        return np.fromiter(map(self.at.__getitem__, distinct), np.int64, len(distinct))

    def ids(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each closed by `end`, and where texts begin in them, with the end."""
        data, offs = utf8(texts)
        cut = stretches(data, offs, self.special) if len(data) else np.zeros(1, np.int64)
        coded = pa.LargeStringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        slot = self.slots(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        size = self.first[slot + 1] - self.first[slot]
        before = np.concatenate([[0], np.cumsum(size)])
        begin = before[np.searchsorted(cut, offs)] + np.arange(len(offs))
        out = np.full(int(begin[-1]), end, np.uint32)
        text = np.searchsorted(offs, cut[:-1], "right") - 1  # each stretch's text
        to = np.arange(before[-1]) + np.repeat(text, size)
        out[to] = self.flat[np.arange(before[-1]) + np.repeat(self.first[slot] - before[:-1], size)]
        return out, begin


def pieces(docs: DataFrame, tokenizer_file: str, size: int = SIZE, end: int = END) -> DataFrame:
    """Every document's pieces; docs: doc_id, text."""

    def run(batches):
        own = Encoder(tokenizer_file)
        for batch in chunks(batches):
            ids, begin = own.ids(batch.column("text"), end)
            n = np.diff(begin)
            count = -(-n // size)
            owner = np.repeat(np.arange(len(n)), count)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            spare = n - size * (count - 1)  # the first piece's length
            start = np.where(number > 0, spare[owner] + size * (number - 1), 0)
            length = np.where(number > 0, size, spare[owner])
            raw, at = memoryview(ids.astype("<u4").tobytes()), begin[:-1][owner] + start
            crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            yield batch_of(doc_id=batch.column("doc_id").take(pa.array(owner)), piece=pa.array(number, pa.int32()), start=pa.array(start, pa.int64()), length=pa.array(length, pa.int64()), ids_crc32=pa.array(crc, pa.int64()))

    return docs.mapInArrow(run, PIECE_SCHEMA)


def best_two_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins, as lists of places in lengths."""
    stacks: dict[int, list[int]] = {}
    for i in np.argsort(-lengths, kind="stable")[::-1].tolist():
        stacks.setdefault(int(lengths[i]), []).append(i)
    left = sum(1 << n for n in stacks)  # bit n: a piece of n is unpacked

    def most(gap: int) -> int:
        return (left & ((2 << gap) - 1)).bit_length() - 1

    def take(n: int) -> int:
        nonlocal left
        i = stacks[n].pop()
        if not stacks[n]:
            left ^= 1 << n
        return i

    def pair(gap: int, over: int) -> tuple[int, int] | None:
        best, found = over, None
        small = left & ((2 << gap // 2) - 1)
        while small and best < gap:
            a = small.bit_length() - 1
            small ^= 1 << a
            b = most(gap - a)
            if a + b > best and (b != a or len(stacks[a]) > 1):
                best, found = a + b, (b, a)
        return found

    bins = []
    while left:
        n = most(size)
        held, gap = [(n, take(n))], size - n
        while gap and (n := most(gap)) > 0:
            held.append((n, take(n)))
            gap -= n
        small = held[-1][0]
        if gap and (two := pair(gap + small, small)):
            n, i = held.pop()
            held += [(m, take(m)) for m in two]
            stacks[n].append(i)
            left |= 1 << n
        bins.append([i for _, i in held])
    return bins


def packed(cut: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset."""
    cut = saved(cut.withColumn("rid", F.monotonically_increasing_id()))
    groups = max(1, -(-cut.count() // group))

    def run(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        held = held.sort_by([("rid", "ascending")])
        lengths = held.column("length").to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, places in enumerate(best_two_fit(lengths, size)):
            sequence[places] = (key[0].as_py() << 32) + k
            offset[places] = np.cumsum(lengths[places]) - lengths[places]
        return held.drop(["rid", "g"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return cut.withColumn("g", F.pmod(F.xxhash64("rid"), F.lit(groups))).groupBy("g").applyInArrow(run, f"{PIECE_SCHEMA}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_file: str, size: int = SIZE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    return packed(pieces(docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text")), tokenizer_file, size), size)
