"""Secrets: fixed patterns, and a linear-chain conditional random field over words.

The field tags each word as the begin of a secret, inside one or outside. Features are
the word's shape, length, mix of characters and key words, those of the words before
and after, and how much of its file looks like settings. It is fitted here on
stretches of words around the patterns' matches and on others, at most SAMPLE of each,
taken by the order of a hash. Stretches with a long run of letters and digits that no
pattern names teach nothing: it may be a secret of another kind, and shouldn't count as
none. A line is one sequence; all lines of a batch are decoded
together by Viterbi's algorithm, those of more than LINE words in blocks of LINE, each
worked out for every tag before it. A run of more than LONG bytes without a space (a
settings file without white space, a query string) is parted behind its marks, and each
part is a word.

Defined cases: a null text is empty and has no spans; a null id stays null; repeated
rows get equal answers; further columns are ignored. Without any match to learn from
nothing is added to the patterns' spans.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import U64, Words, WordTable, batch_of, chunks, code_points, col, mix, prefix_hash, saved, span_hash, utf8

KINDS = ("assign", "access", "hex", "crf")
CRF = 3
OUT, BEGIN, IN = range(3)
SAMPLE, AROUND, LINE, LONG, FEATURES = 700, 12, 256, 200, 1 << 12
#: Fixed patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_NAMED = re.compile("passw|secret|token|api_?key|auth|credential|private", re.IGNORECASE)
#: Marks behind which long runs are parted.
_MARKS = np.isin(np.arange(256), list(b",;&?|:={}[]()<>"))
#: A run of letters and digits that may be a secret of a kind without a pattern.
_MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[^0-9\s]*[0-9])(?=[^A-Za-z\s]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}+(?![.:/@])")
_HEXES = np.isin(np.arange(256), list(b"0123456789abcdef"))


class Pieces(Words):
    """Words as they are written, those of more than LONG bytes parted behind their marks."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        super().__init__(data, offs, lower=False)
        parts, kept = [], np.ones(len(self.start), bool)
        for i in np.flatnonzero(self.end - self.start > LONG).tolist():
            a, b = int(self.start[i]), int(self.end[i])
            cut = np.flatnonzero(_MARKS[data[a : b - 1]]) + 1
            if len(cut):
                kept[i] = False
                start, end = np.concatenate([[0], cut]), np.concatenate([cut, [b - a]])
                parts.append((start + a, end + a, span_hash(prefix_hash(data[a:b]), start, end)))
        if parts:
            start, self.end, self.hash = (np.concatenate([old[kept], *new]) for old, new in zip((self.start, self.end, self.hash), zip(*parts, strict=True), strict=True))
            order = np.argsort(start, kind="stable")
            self.start, self.end, self.hash = start[order], self.end[order], self.hash[order]
            self.first = np.searchsorted(self.start, offs)


def base_spans(text: str, hexes: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted; hexes: whether a long hex run may be there."""
    out, low = [], text.lower()
    if any(k in low for k in _KEYS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    if hexes:
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def hex_rows(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows in which 32 bytes on end may be a hex run."""
    edge = np.concatenate([[-1], np.flatnonzero(~_HEXES[data]), [len(data)]])
    long = np.flatnonzero(np.diff(edge) > 32)
    rows = np.zeros(len(offs) - 1, bool)
    for start, end in zip(edge[long] + 1, edge[long + 1], strict=True):
        rows[np.searchsorted(offs, start, "right") - 1 : np.searchsorted(offs, end - 1, "right")] = True
    return rows


#: A word of letters with marks behind it: all that matters of it is its case, size and last mark.
_PLAIN = re.compile(r"([^\W\d_]+)([^\w=:@/+]*)")


def plain(word: str) -> tuple[str, int, str] | None:
    m = _PLAIN.fullmatch(word)
    if not m or _NAMED.search(word):
        return None
    core = m[1]
    return "A" if core.isupper() else "Aa" if core[0].isupper() else "a", min(len(core), 64) // 4, m[2][-1:]


def features(word: str) -> tuple[list[str], list[str]]:
    """Of a word: as itself, and as a neighbour."""
    if key := plain(word):
        return [f"plain {key[0]}", f"plain size {key[1]}"], [f"ends {key[2]}", f"n {min(key[1], 10) // 2}"]
    shape = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "a" if m[0].islower() else "Aa" if m[0][1:].islower() else "aA", re.sub("[0-9]+", "9", word))
    core = word.strip("\"',;:.()[]{}*#$%&!?")
    n, counts = len(core), Counter(core)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0
    short = shape if len(shape) <= 10 else shape[:5] + "~" + shape[-4:]
    own = ["shape " + short, f"size {min(n, 64) // 4}", f"entropy {int(2 * entropy)}", f"digits {min(9, sum(x.isdigit() for x in core) * 10 // max(1, n))}"]
    own += [f"kinds {sum((any(map(str.islower, core)), any(map(str.isupper, core)), any(map(str.isdigit, core)), not core.isalnum()))} {n >= 16}"]
    own += [f"named {m[0].lower()}" for m in [_NAMED.search(word)] if m] + ["mixed"] * bool(_MIXED.search(word)) + ["hex"] * bool(n >= 16 and re.fullmatch("[0-9a-fA-F]+", core)) + ["access"] * core.startswith("AKIA")
    own += [f"sign {x}" for x in "=:\"'" if x in word] + ["at"] * ("@" in word)
    near = [f"ends {word[-1:] if not word[-1:].isalnum() else ''}", f"n {min(n, 40) // 8}"] + [f"n named {m[0].lower()}" for m in [_NAMED.search(word)] if m] + [f"n sign {x}" for x in "=:" if x in word]
    return own, near


def number(feature: str) -> int:
    h = 0
    for c in feature.encode():
        h = (h * 1099511628211 + c + 1) % (1 << 64)
    return (h ^ h >> 29) % FEATURES


class Field:
    """Weights: of features by role (own, before, after), of the file's kind, and of one tag after another; -1 begins a line."""

    def __init__(self):
        self.w, self.file, self.step = np.zeros((3, FEATURES, 3)), np.zeros((4, 3)), np.zeros((3, 3))
        self.learnt = False

    def rows(self, words: list[str]) -> np.ndarray:
        """Per word nine numbers: its share in its own score, in the next word's and in that of the word before."""
        known: dict[tuple, np.ndarray] = {}
        out = []
        for word in words:
            key = plain(word)
            row = known.get(key) if key else None
            if row is None:
                own, near = (list(map(number, f)) for f in features(word))
                row = np.concatenate([self.w[0, own].sum(0), self.w[1, near].sum(0), self.w[2, near].sum(0)])
                if key:
                    known[key] = row
            out.append(row)
        return np.array(out).reshape(-1, 9)


def fit(stretches: list[tuple[list[str | tuple], list[int], int]], rounds: int = 30, rate: float = 0.15) -> Field:
    """Adagrad on the sequences' conditional log-likelihood; a stretch: words or their features, tags, the file's kind."""
    field = Field()
    if not any(t for _, tags, _ in stretches for t in tags):
        return field
    size = max(len(w) for w, _, _ in stretches)
    n = len(stretches)
    live, gold, kind = np.zeros((size, n), bool), np.zeros((size, n), int), np.array([f for _, _, f in stretches])
    parts: list[list[tuple[int, int, int]]] = [[], [], []]  # by role: (position * n + stretch, feature)
    for k, (words, tags, _) in enumerate(stretches):
        live[: len(words), k], gold[: len(words), k] = True, tags
        for t, word in enumerate(words):
            own, near = features(word) if isinstance(word, str) else word
            parts[0] += [(t * n + k, number(f)) for f in own]
            if t + 1 < len(words):
                parts[1] += [((t + 1) * n + k, number(f)) for f in near]
            if t:
                parts[2] += [((t - 1) * n + k, number(f)) for f in near]
    at = [np.array(p, int).reshape(-1, 2) for p in parts]
    sums = [np.full_like(x, 1e-6) for x in (field.w, field.file, field.step)]
    truth = np.eye(3)[gold] * live[..., None]
    pairs = (live[1:] & live[:-1])[..., None, None]
    steps_true = (truth[:-1, :, :, None] * truth[1:, :, None, :] * pairs).sum((0, 1))
    for _ in range(rounds):
        e = np.zeros((size * n, 3))
        for role in range(3):
            for c in range(3):
                e[:, c] += np.bincount(at[role][:, 0], field.w[role, at[role][:, 1], c], size * n)
        e = e.reshape(size, n, 3) + field.file[kind]
        e[0, :, IN] -= 20
        step = field.step.copy()
        step[OUT, IN] = -20
        a, b = np.zeros((size, n, 3)), np.zeros((size, n, 3))
        a[0] = e[0]
        for t in range(1, size):
            a[t] = np.where(live[t][:, None], np.logaddexp.reduce(a[t - 1][:, :, None] + step, 1) + e[t], a[t - 1])
        for t in range(size - 2, -1, -1):
            b[t] = np.where(live[t + 1][:, None], np.logaddexp.reduce(step + (e[t + 1] + b[t + 1])[:, None, :], 2), 0)
        z = np.logaddexp.reduce(a[-1], 1)
        post = np.exp(a + b - z[None, :, None]) * live[..., None]
        both = np.exp(np.minimum(0, a[:-1, :, :, None] + step + (e[1:] + b[1:])[:, :, None, :] - z[None, :, None, None])) * pairs
        d = ((truth - post) / n).reshape(-1, 3)
        grads = [np.zeros_like(field.w), np.zeros_like(field.file), steps_true / n - both.sum((0, 1)) / n]
        for role in range(3):
            for c in range(3):
                grads[0][role, :, c] = np.bincount(at[role][:, 1], d[at[role][:, 0], c], FEATURES)
        np.add.at(grads[1], kind, d.reshape(size, n, 3).sum(0))
        for x, g, s in zip((field.w, field.file, field.step), grads, sums, strict=True):
            g -= 1e-5 * x
            s += g * g
            x += rate * g / np.sqrt(s)
    field.step[OUT, IN] = -20
    field.learnt = True
    return field


def file_kinds(w: Words) -> np.ndarray:
    """Per text 0 to 3 by the share of its words that hold = or :."""
    marks = np.concatenate([[0], np.cumsum((w.data == 61) | (w.data == 58))])
    n = np.diff(w.first)
    share = np.zeros(len(n))
    full = n > 0
    share[full] = (marks[w.offs[1:]] - marks[w.offs[:-1]])[full] / n[full]
    return np.digitize(share, [0.002, 0.02, 0.1])


def decode(e: np.ndarray, begins: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The best tags of sequences that lie one after another; e: scores [word, tag], begins: where each starts."""
    n = len(e)
    whole = np.diff([*begins, n])
    size = (whole - 1) % LINE + 1  # the rest is blocks of LINE words
    order = np.argsort(-size, kind="stable")
    first, size, whole = begins[order], size[order], whole[order]
    tags, back = np.zeros(n, np.int8), np.zeros((n, 3), np.int8)
    score = e[first] - np.array([0, 0, 20])
    final = score.copy()
    live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")
    for t in range(1, int(size[0])):
        k = live[t]
        by = score[:k, :, None] + step
        at = first[:k] + t
        back[at] = by.argmax(1)
        score = by.max(1) + e[at]
        final[:k] = score
    tag = final.argmax(1).astype(np.int8)
    long = np.flatnonzero(whole > size)
    if len(long):
        tag[long] = blocks(e, first[long] + size[long], (whole[long] - size[long]) // LINE, final[long], step, tags)
    for t in range(int(size[0]) - 1, -1, -1):
        k = live[t]
        at = first[:k] + t
        tags[at] = tag[:k]
        if t:
            tag[:k] = back[at, tag[:k]]
    return tags


def blocks(e: np.ndarray, first: np.ndarray, count: np.ndarray, score: np.ndarray, step: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Fills in the best tags of sequences of count blocks from first on, given each one's scores of the tag before, and returns that tag."""
    at = np.concatenate([a + LINE * np.arange(c) for a, c in zip(first, count, strict=True)])
    best, back = step + e[at][:, None, :], np.zeros((LINE, len(at), 3, 3), np.int8)  # by block, tag before it and last tag
    for t in range(1, LINE):
        by = best[:, :, :, None] + step
        back[t] = by.argmax(2)
        best = by.max(2) + e[at + t][:, None, :]
    before, last, begin = np.zeros(len(at), np.int8), np.zeros(len(at), np.int8), 0
    out = np.zeros(len(first), np.int8)
    for i, c in enumerate(count.tolist()):
        now, came = score[i], []
        for b in range(begin, begin + c):
            by = now[:, None] + best[b]
            came.append(by.argmax(0))
            now = by.max(0)
        tag = int(now.argmax())
        for b in range(begin + c - 1, begin - 1, -1):
            last[b], tag = tag, int(came[b - begin][tag])
            before[b] = tag
        out[i], begin = tag, begin + c
    for t in range(LINE - 1, -1, -1):
        tags[at + t] = last
        if t:
            last = back[t, np.arange(len(at)), before, last]
    return out


def lines(w: Words) -> np.ndarray:
    """Where sequences begin: at texts and after line ends."""
    breaks = np.concatenate([[0], np.cumsum(w.data == 10)])
    new = np.ones(len(w.start), bool)
    new[1:] = breaks[w.start[1:]] > breaks[w.end[:-1]]
    firsts = w.first[:-1]
    new[firsts[firsts < len(new)]] = True
    return np.flatnonzero(new)


def tagged(w: Words, field: Field, cache: WordTable) -> np.ndarray:
    rows = cache.index(w)
    r, begins = cache.rows[rows].astype(float), lines(w)
    e = r[:, :3].copy()
    inner = np.ones(len(e), bool)
    inner[begins] = False
    at = np.flatnonzero(inner)
    e[at] += r[at - 1, 3:6]
    e[at - 1] += r[at, 6:9]
    e += field.file[file_kinds(w)][w.row]
    return decode(e, begins, field.step)


def _found(batches, field: Field):
    """Batches with their base spans and the field's."""
    cache = WordTable(9, field.rows, limit=200_000)
    for batch in chunks(batches):
        texts = batch.column("text").to_pylist()
        data, offs = utf8(batch.column("text"))
        hexes = hex_rows(data, offs)
        base = [base_spans(t, h) if t else [] for t, h in zip(texts, hexes.tolist(), strict=True)]
        more: list[list] = [[] for _ in texts]
        w = Pieces(data, offs)
        if field.learnt and len(w.hash):
            tags = tagged(w, field, cache)
            begin = np.flatnonzero((tags == BEGIN) | ((tags == IN) & np.concatenate([[True], tags[:-1] == OUT])))
            rows, points = w.row, code_points(data)
            for i in begin.tolist():
                j = i
                while j + 1 < len(tags) and tags[j + 1] == IN and rows[j + 1] == rows[i]:
                    j += 1
                o = points[offs[rows[i]]]
                s, f = int(points[w.start[i]] - o), int(points[w.end[j]] - o)
                if all(f <= x or y <= s for x, _, y in base[rows[i]]):
                    more[rows[i]].append((s, CRF, f))
        yield batch, base, [sorted(b + m) for b, m in zip(base, more, strict=True)]


def stretches(docs: DataFrame, kinds: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Training stretches: words (of long ones the features instead), tags, file, hit (whether a pattern of these kinds matches in it) and h, a hash to choose by; docs: text."""

    def run(batches):
        for batch in chunks(batches):
            data, offs = utf8(batch.column("text"))
            w, hexes = Pieces(data, offs), hex_rows(data, offs)
            files, points, first = file_kinds(w), code_points(data), w.first
            out: dict[str, list] = {"words": [], "features": [], "tags": [], "file": [], "hit": [], "h": []}
            for i, text in enumerate(batch.column("text").to_pylist()):
                if not text or first[i] == first[i + 1]:
                    continue
                a, b = int(first[i]), int(first[i + 1])
                s, f = points[w.start[a:b]] - points[offs[i]], points[w.end[a:b]] - points[offs[i]]
                tag = np.zeros(b - a, int)
                found = [x for x in base_spans(text, hexes[i]) if x[1] in kinds]
                for x, _, y in found:
                    m = np.flatnonzero((s < y) & (f > x))
                    tag[m] = IN
                    tag[m[:1]] = BEGIN
                seed = int(mix(w.hash[a : a + 1] ^ w.hash[b - 1 : b])[0])
                places = [(int(np.searchsorted(f, x, "right")), True) for x, _, _ in found] + [(seed % (b - a), False)]
                for p, hit in places:
                    lo, hi = max(0, p - AROUND), min(b - a, p + AROUND)
                    words = [w.text(a + k) for k in range(lo, hi)]
                    if any(not t and _MIXED.search(x) for t, x in zip(tag[lo:hi].tolist(), words, strict=True)):
                        continue
                    out["words"].append([x if len(x) <= LONG else "" for x in words])
                    out["features"].append([None if len(x) <= LONG else list(features(x)) for x in words])
                    out["tags"].append(tag[lo:hi].tolist())
                    out["file"].append(int(files[i]))
                    out["hit"].append(hit)
                    out["h"].append(int(mix(np.array([seed ^ p], np.uint64))[0] >> U64(2)))
            yield batch_of(words=pa.array(out["words"], pa.list_(pa.string())), features=pa.array(out["features"], pa.list_(pa.list_(pa.list_(pa.string())))), tags=pa.array(out["tags"], pa.list_(pa.int32())), file=pa.array(out["file"], pa.int32()), hit=pa.array(out["hit"], pa.bool_()), h=pa.array(out["h"], pa.int64()))

    return docs.mapInArrow(run, "words array<string>, features array<array<array<string>>>, tags array<int>, file int, hit boolean, h long")


def trained(docs: DataFrame, text: str = "text", sample: int = SAMPLE, kinds: tuple[int, ...] = (0, 1, 2)) -> Field:
    """A field fitted on what the patterns of these kinds find in docs."""
    drawn = saved(stretches(docs.select(col(text).alias("text")), kinds))
    counts = drawn.groupBy("hit").agg(F.count("*").alias("all"))
    # only about twice the sample of either kind is ordered, whatever their numbers
    few = drawn.join(F.broadcast(counts), "hit").where(F.col("h") < (1 << 62) * 2.0 * sample / F.col("all"))
    drawn = few.withColumn("n", F.row_number().over(_by_hash())).where(F.col("n") <= sample)
    rows = sorted(drawn.collect(), key=lambda r: (r.hit, r.h, r.words))
    words = [[w if f is None else tuple(f) for w, f in zip(r.words, r.features, strict=True)] for r in rows]
    return fit([(w, list(r.tags), r.file) for w, r in zip(words, rows, strict=True)])


def _by_hash():
    from pyspark.sql import Window

    return Window.partitionBy("hit").orderBy("h", "words", "features")


def report(docs: DataFrame, field: Field, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, counts of the base kinds, their digest, all spans as text."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch, base, every in _found(batches, shared.value):
            yield batch_of(doc_id=batch.column("doc_id"), base=pa.array([S.structs(x) for x in base], S.ARROW), spans=pa.array([S.structs(x) for x in every], S.ARROW))

    out = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text")).mapInArrow(run, f"doc_id long, base {S.TYPE}, spans {S.TYPE}")
    base = F.col("base")
    return out.select("doc_id", *(S.count_of(base, i).alias(f"n_{k}") for i, k in enumerate(KINDS[:CRF])), S.digest(base, KINDS).alias("base_sha256"), S.as_text(F.col("spans"), KINDS).alias("spans"))
