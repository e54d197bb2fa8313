"""Language identification by unigram pieces, summed over all segmentations.

Each language has one probability per piece of a fixed public vocabulary,
fitted by expectation-maximisation. A text's likelihood under a language is the
product over its letter runs of the sum, over every way to cut the run into
pieces, of the pieces' probabilities (the forward algorithm).

Defined cases: a null text, or one without a letter, is `und` with score 0. Rows
are judged one by one, so repeated rows and ids get equal answers and a null id
stays null. Ties go to the first language in order. No labelled rows at all: every
text is `und`. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Words, WordTable, batch_of, chunks, col, kept_rows, pick, utf8

#: A run's first piece carries this mark in the vocabulary file.
MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
#: Longest piece used, and the stretch at which longer letter runs are cut.
PIECE, RUN = 7, 48
#: The fitting sample: so many labelled documents of each language, none longer than this.
SAMPLE_DOCS, SAMPLE_CHARS = 150, 20_000
UNKNOWN = 1e-9
HASH = 0x9E3779B97F4A7C15
#: Words here are runs of ASCII letters and bytes of other scripts: few distinct ones.
BETWEEN = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def vocabulary(model_file: str) -> dict[str, int]:
    """Lower-cased pieces of letters, with their numbers."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return {p: i for i, p in enumerate(sorted(p for p in pieces if len(p) <= PIECE + 1 and (p == MARK or LETTERS.fullmatch(p.removeprefix(MARK)))))}


class Pieces:
    """Numbers of pieces by a polynomial hash of their code points, in tables of which each takes what the one before could not."""

    BITS = 18

    def __init__(self, vocab: dict[str, int]):
        self.size, left = len(vocab), np.arange(len(vocab))
        self.keys = np.zeros(len(vocab) + 1, np.uint64)
        for piece, i in vocab.items():
            h = 0
            for c in piece:
                h = (h * HASH + ord(c)) % (1 << 64)
            self.keys[i] = h
        self.tables: list[tuple[np.uint64, np.ndarray]] = []
        while len(left):
            factor, slots = U64(HASH + 2 * len(self.tables)), np.full(1 << self.BITS, self.size, np.int32)
            at = self.slot(self.keys[left], factor)
            slots[at] = left
            self.tables.append((factor, slots))
            left = left[slots[at] != left]

    def slot(self, h: np.ndarray, factor: np.uint64) -> np.ndarray:
        return ((h ^ (h >> U64(29))) * factor) >> U64(64 - self.BITS)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(h.shape, -1, np.int32)
        for factor, slots in self.tables:
            x = slots[self.slot(h, factor)]
            np.copyto(out, x, where=self.keys[x] == h)
        return out


def lattice(words: list[str], pieces: Pieces) -> np.ndarray:
    """For words of one length: [start, length - 1, word] -> piece number, or pieces.size for a lone unknown letter, else -1."""
    n = len(words[0])
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).T.astype(np.uint64)
    out = np.full((n, min(PIECE, n), len(words)), -1, np.int32)
    for i in range(n):
        h = np.full(len(words), ord(MARK) if i == 0 else 0, np.uint64)
        for l in range(min(PIECE, n - i)):
            h = h * U64(HASH) + points[i + l]
            out[i, l] = pieces.find(h)
    lone = out[:, 0]
    lone[lone < 0] = pieces.size
    return out


def forward(ids: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of all prefixes, [position, word, language]; p: [piece, language], with a last row of zeros for -1."""
    size, longest, n = ids.shape
    alpha = np.zeros((size + 1, n, p.shape[1]))
    alpha[0] = 1
    for j in range(1, size + 1):
        for l in range(1, min(longest, j) + 1):
            alpha[j] += alpha[j - l] * p[ids[j - l, l - 1]]
    return alpha, alpha[size]


def backward(ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    size, longest, n = ids.shape
    beta = np.zeros((size + 1, n, p.shape[1]))
    beta[size] = 1
    for i in range(size - 1, -1, -1):
        for l in range(1, min(longest, size - i) + 1):
            beta[i] += p[ids[i, l - 1]] * beta[i + l]
    return beta


def by_length(runs: list[str]):
    lengths = np.fromiter(map(len, runs), int, len(runs))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for k in range(0, len(at), 20_000):
            yield at[k : k + 20_000]


def letter_runs(word: str) -> list[str]:
    return [run[i : i + RUN] for run in LETTERS.findall(word.lower()) if any(map(str.isalpha, run)) for i in range(0, len(run), RUN)]


@dataclass
class Model:
    languages: list[str]
    pieces: Pieces
    p: np.ndarray  # [piece, language]; the last two rows: an unknown letter, no piece

    def runs_log(self, runs: list[str]) -> np.ndarray:
        out = np.zeros((len(runs), len(self.languages)))
        for at in by_length(runs):
            out[at] = np.log(np.maximum(forward(lattice([runs[i] for i in at], self.pieces), self.p)[1], 1e-300))
        return out

    def words_log(self, words: list[str]) -> np.ndarray:
        """Log probability of each word under each language, and last its number of letter runs."""
        runs = [letter_runs(w) for w in words]
        at = {r: i for i, r in enumerate(dict.fromkeys(r for x in runs for r in x))}
        logs, owner = self.runs_log(list(at)), np.repeat(np.arange(len(words)), [len(x) for x in runs])
        out = np.zeros((len(words), len(self.languages) + 1))
        if len(owner):
            each = np.fromiter((at[r] for x in runs for r in x), int, len(owner))
            np.add.at(out, owner, np.column_stack([logs[each], np.ones(len(owner))]))
        return out


def fit(texts: list[tuple[str, str]], vocab: dict[str, int], rounds: int = 4) -> Model:
    """Expectation-maximisation over (language, text) pairs."""
    counts: dict[str, Counter] = {}
    for lang, text in texts:
        counts.setdefault(lang, Counter()).update(r for w in text.split() for r in letter_runs(w))
    languages, size = sorted(counts), len(vocab) + 2
    p = np.full((size, len(languages)), 1 / size)
    p[-1] = 0
    runs = sorted({r for c in counts.values() for r in c})
    weight = np.array([[counts[l][r] for l in languages] for r in runs], float).reshape(len(runs), len(languages))
    pieces = Pieces(vocab)
    groups = [(at, lattice([runs[i] for i in at], pieces)) for at in by_length(runs)]
    for _ in range(rounds):
        seen = np.zeros_like(p)
        for at, ids in groups:
            alpha, total = forward(ids, p)
            beta, share = backward(ids, p), weight[at] / np.maximum(total, 1e-300)
            for i in range(len(ids)):
                for l in range(1, min(ids.shape[1], len(ids) - i) + 1):
                    x = ids[i, l - 1]
                    real = x >= 0
                    y = (alpha[i] * p[x] * beta[i + l] * share)[real]
                    for k in range(len(languages)):
                        seen[:, k] += np.bincount(x[real], y[:, k], size)
        p = (seen + 0.01) / (seen.sum(0) + 0.01 * size)
        p[-2:] = [[UNKNOWN], [0]]
    return Model(languages, pieces, p)


def sample(docs: DataFrame, docs_each: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """At most docs_each labelled texts of each language, by the order of a hash, of longer ones `chars` characters from a place by that hash; docs: text, lang."""
    docs = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).withColumn("h", F.xxhash64("text"))
    docs = docs.withColumn("text", F.substring("text", F.pmod("h", F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1, chars))
    counts = docs.groupBy("lang").count()
    few = docs.join(F.broadcast(counts), "lang").where(F.pmod("h", F.lit(1 << 20)) < (1 << 20) * 2.0 * docs_each / F.col("count"))
    first = Window.partitionBy("lang").orderBy("h")
    return [(r.lang, r.text) for r in few.withColumn("n", F.row_number().over(first)).where(F.col("n") <= docs_each).orderBy("lang", "n").collect()]


def score(texts: pa.Array, model: Model, cache: WordTable) -> tuple[list, np.ndarray]:
    """The languages (und: None) and scores of texts."""
    words = Words(*utf8(texts), between=BETWEEN)
    sums = np.zeros((len(texts), cache.width))
    if len(words.hash):
        at = cache.index(words)
        each = cache.rows[at].astype(float)
        full = np.flatnonzero(np.diff(words.first))
        sums[full] = np.add.reduceat(each, words.first[full])
    n, logs = sums[:, -1], sums[:, :-1]
    if not model.languages:
        return [None] * len(n), np.zeros(len(n))
    logs = (logs - logs.max(1, keepdims=True)) * np.minimum(1, 20 / np.maximum(n, 1))[:, None]
    share = np.exp(logs) / np.exp(logs).sum(1, keepdims=True)
    best = share.argmax(1)
    return [model.languages[b] if k else None for b, k in zip(best, n, strict=True)], np.where(n > 0, share[np.arange(len(n)), best], 0)


def trained(docs: DataFrame, vocab_file: str, text: str = "text", lang: str = "lang") -> Model:
    return fit(sample(pick(docs, text=text, lang=lang)), vocabulary(vocab_file))


def identify(docs: DataFrame, model: Model, held_out: F.Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        cache = WordTable(len(model.languages) + 1, model.words_log)
        for batch in chunks(batches):
            langs, scores = score(batch.column("text"), model, cache)
            yield batch_of(doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), lang_pred=pa.array([x or "und" for x in langs], pa.string()), score=pa.array(scores, pa.float64()))

    return docs.select(col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), col(text).alias("text")).mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.4, text: str = "text") -> DataFrame:
    """The rows whose language is known with at least that score, all their columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep():
        model = shared.value
        cache = WordTable(len(model.languages) + 1, model.words_log)

        def known(texts: pa.Array) -> np.ndarray:
            langs, scores = score(texts, model, cache)
            return np.array([x is not None for x in langs], bool) & (scores >= least)

        return known

    return kept_rows(docs, text, keep)
