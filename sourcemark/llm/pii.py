"""Personal data: fixed patterns, and terms that give a protected value away.

Each value that a pattern finds (an address, a card, ...) is a protected entity. A
term discloses it by their pointwise mutual information over the corpus, as a share of
the entity's information content -log p(entity); both are counted by documents, wherever
in them they stand. In documents that hold the entity, every occurrence of a term from
GENERALISE on is replaced by its class and of one from REMOVE on dropped.

Entities that stand in the same documents have the same terms, so they are counted as
one group. A pair's documents are at most the entity's, which bounds its share: terms
that are too frequent for any group of their document are left out before pairs are made.

Defined cases: a null text is empty and has no spans; a null id stays null; repeated
rows count as documents of their own and get equal answers; further columns are
ignored (spans) or kept as they were (redact). An empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans as S
from .common import U64, Words, batch_of, chunks, code_points, col, mix, pick, saved, utf8

KINDS = ("email", "ip", "card", "phone", "term")
TERM = 4
#: Fixed patterns: the part after an address's name, dotted quads, cards, phones.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: The shortest term; shares of the entity's information.
SHORTEST, GENERALISE, REMOVE = 3, 0.9, 0.98
#: Of the terms that are too frequent for every entity, so many are left out where texts are read, the others by a join.
FREQUENT = 100_000
#: Terms are runs of ASCII letters and of bytes of other scripts, lower-cased.
BETWEEN = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern, found from each @ outwards: a name can't hold one."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    out = [(s, 0, f) for s, f in emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x) <= 3 and int(x) <= 255 for x in (g.lstrip("0") or "0" for g in m.groups()))]
        for m in _CARD.finditer(text):
            if 12 <= len(digits := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def entity(text: str, span: tuple[int, int, int]) -> int:
    """A number for a protected value: cards and phones by their digits."""
    value = text[span[0] : span[2]].lower() if span[1] < 2 else re.sub("[^0-9]", "", text[span[0] : span[2]])
    h = np.uint64(span[1] + 1)
    for i in range(0, len(raw := value.encode()), 8):
        h = mix(np.array([h ^ U64(int.from_bytes(raw[i : i + 8], "little"))], np.uint64))[0] + U64(i)
    return int(h.view(np.int64))


def _scan(batches):
    for batch in chunks(batches):
        texts = batch.column("text").to_pylist()
        lists = [base_spans(text) if text else [] for text in texts]
        entities = [sorted({entity(text, span) for span in found}) for text, found in zip(texts, lists, strict=True)]
        held = [text if found else None for text, found in zip(texts, lists, strict=True)]
        yield batch_of(doc_id=batch.column("doc_id"), h=batch.column("h"), base=pa.array([S.structs(found) for found in lists], S.ARROW), entities=pa.array(entities, pa.list_(pa.int64())), text=pa.array(held, pa.string()))


def _terms(texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts, where each starts and ends in its text in code points, and whether it is long enough for a term."""
    data, offs = utf8(texts)
    w, points = Words(data, offs, between=BETWEEN), code_points(data)
    before = points[offs[w.row]]
    start, end = points[w.start] - before, points[w.end] - before
    return w, start, end, end - start >= SHORTEST


class Tally:
    """Counts by 64-bit key, merged whenever many have come together."""

    def __init__(self, limit: int = 2_000_000):
        self.limit, self.held, self.parts = limit, 0, []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held > self.limit:
            self.merge()
            self.limit = max(self.limit, 2 * self.held)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if self.parts:
            keys, at = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
            self.parts = [(keys, np.bincount(at, np.concatenate([c for _, c in self.parts]), len(keys)).astype(np.int64))]
            self.held = len(keys)
        return self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _frequencies(batches):
    """Documents that hold each term, by partition."""
    tally = Tally()
    for batch in chunks(batches):
        w = Words(*utf8(batch.column("text")), between=BETWEEN)
        _, first = np.unique(w.hash ^ mix(w.row.astype(np.uint64)), return_index=True)
        tally.add(*np.unique(w.hash[first], return_counts=True))
        if tally.held > 1_500_000:
            yield _tally_rows(tally)
            tally = Tally()
    yield _tally_rows(tally)


def _tally_rows(tally: Tally) -> pa.RecordBatch:
    keys, counts = tally.merge()
    return batch_of(t=pa.array(keys.view(np.int64)), n=pa.array(counts))


def scanned(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): rid, doc_id, h (a hash of the text), base spans, the distinct entities and, if there are any, the text."""
    wide = docs.withColumn("h", F.xxhash64("text"))
    out = wide.mapInArrow(_scan, f"doc_id long, h long, base {S.TYPE}, entities array<long>, text string")
    return saved(out.withColumn("rid", F.monotonically_increasing_id()))


def disclosing(rows: DataFrame, docs: DataFrame, least: float = GENERALISE) -> DataFrame:
    """rid, t and share of the terms that disclose an entity of their document, the largest share of each; rows: of scanned()."""
    total = rows.count()
    some = rows.where(F.size("entities") > 0)
    held = some.select("rid", F.explode("entities").alias("e"))
    of = held.groupBy("e").agg(F.count("*").alias("n_g"), F.bit_xor(F.xxhash64("rid")).alias("g")).where(F.col("n_g") < total)
    group = saved(held.join(of, "e").select("rid", "g", "n_g").distinct())
    most = group.agg(F.max("n_g")).first()[0]
    terms = saved(docs.select("text").mapInArrow(_frequencies, "t long, n long").groupBy("t").agg(F.sum("n").alias("n_t")))

    def bound(n_g):
        """The most documents of a term that can reach the share, with room for rounding."""
        return F.pow(n_g, F.lit(least)) * F.pow(F.lit(float(total)), F.lit(1 - least)) * (1 + 1e-9)

    often = terms.where(F.col("n_t") > bound(F.lit(float(most or 0)))).orderBy(F.desc("n_t"), "t").limit(FREQUENT)
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r.t for r in often.collect()], np.int64)))

    def distinct(batches):
        often = shared.value
        for batch in chunks(batches):
            w, _, _, free = _terms(batch.column("text"))
            free &= ~np.isin(w.hash.view(np.int64), often)
            _, first = np.unique(w.hash[free] ^ mix(w.row[free].astype(np.uint64)), return_index=True)
            at = np.flatnonzero(free)[first]
            yield batch_of(rid=batch.column("rid").take(pa.array(w.row[at])), t=pa.array(w.hash[at].view(np.int64)))

    fits = F.col("n_t") <= bound(F.col("n_g"))
    pair = some.select("rid", "text").mapInArrow(distinct, "rid long, t long").join(terms, "t").where(F.col("n_t") <= bound(F.lit(float(most or 0)))).join(group, "rid").where(fits)
    share = F.log(F.col("joint") * total / (F.col("n_g") * F.col("n_t"))) / F.log(total / F.col("n_g"))
    by = pair.groupBy("g", "n_g", "t", "n_t").agg(F.count("*").alias("joint")).select("g", "n_g", "t", share.alias("share")).where(F.col("share") >= least)
    return pair.select("rid", "g", "n_g", "t").join(by, ["g", "n_g", "t"]).groupBy("rid", "t").agg(F.max("share").alias("share"))


def _marked(batches):
    """Every occurrence of a row's terms outside its base spans, sorted, and its share."""
    for batch in chunks(batches):
        w, start, end, free = _terms(batch.column("text"))
        hashes, spans, shares = w.hash.view(np.int64), [], []
        for i, (base, terms) in enumerate(zip(batch.column("base").to_pylist(), batch.column("terms").to_pylist(), strict=True)):
            at = np.arange(w.first[i], w.first[i + 1])
            known = {x["t"]: x["share"] for x in terms}
            at = at[free[at] & np.isin(hashes[at], np.array(list(known), np.int64))]
            for x in base:
                at = at[(end[at] <= x["s"]) | (start[at] >= x["f"])]
            spans.append([{"s": s, "k": TERM, "f": f} for s, f in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            shares.append([known[t] for t in hashes[at].tolist()])
        yield batch_of(rid=batch.column("rid"), terms=pa.array(spans, S.ARROW), shares=pa.array(shares, pa.list_(pa.float64())))


def found(docs: DataFrame) -> DataFrame:
    """rid, doc_id, h, base and all spans, and the shares of the term spans in their order; docs: doc_id, text."""
    rows = scanned(docs)
    each = disclosing(rows, docs).groupBy("rid").agg(F.collect_list(F.struct("t", "share")).alias("terms"))
    marked = rows.join(each, "rid").select("rid", "base", "text", "terms").mapInArrow(_marked, f"rid long, terms {S.TYPE}, shares array<double>")
    both = rows.drop("text", "entities").join(marked, "rid", "left")
    return both.select("rid", "doc_id", "h", "base", F.array_sort(F.concat("base", F.coalesce("terms", F.expr(f"cast(array() as {S.TYPE})")))).alias("spans"), "shares")


def report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, counts of the base kinds, their digest, all spans as text."""
    base: Column = F.col("base")
    out = found(docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text")))
    return out.select("doc_id", *(S.count_of(base, i).alias(f"n_{k}") for i, k in enumerate(KINDS[:TERM])), S.digest(base, KINDS).alias("base_sha256"), S.as_text(F.col("spans"), KINDS).alias("spans"))


def redacted(text: str, spans: list[dict], shares: list[float]) -> str:
    """Base spans become their kind in brackets, terms their class, or nothing from REMOVE on."""
    out, at, shares = [], 0, iter(shares or ())
    for x in spans:
        share = next(shares) if x["k"] == TERM else 0
        if x["s"] < at:
            at = max(at, x["f"])
            continue
        word = text[x["s"] : x["f"]]
        out += [text[at : x["s"]], f"[{KINDS[x['k']].upper()}]" if x["k"] != TERM else "" if share >= REMOVE else "[NAME]" if word[:1].isupper() else "[WORD]"]
        at = x["f"]
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The same rows and columns with the spans taken out of the text (and n_chars, where there is one, counted anew)."""
    named = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    marks = found(named).where(F.size("spans") > 0).dropDuplicates(["doc_id", "h"]).select("doc_id", "h", "spans", "shares")
    left = docs.select(F.struct("*").alias("row"), col(doc_id).cast("long").alias("id"), F.xxhash64(col(text)).alias("th"), col(text).alias("text"))
    both = left.join(marks, left.id.eqNullSafe(marks.doc_id) & (left.th == marks.h), "left").select("row", "text", "spans", "shares")

    def run(batches):
        for batch in batches:
            new = [t if not s else redacted(t, s, p) for t, s, p in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "shares")), strict=True)]
            yield batch_of(row=batch.column("row"), new=pa.array(new, pa.string()))

    done = both.mapInArrow(run, T.StructType([left.schema["row"], T.StructField("new", T.StringType())]))
    return done.select([(F.col("new") if c == text else F.when(F.col("new").isNotNull(), F.length("new")).cast(docs.schema[c].dataType) if c == "n_chars" else F.col("row").getField(c)).alias(c) for c in docs.columns])
