"""One anchor per unit of an answer: the numeral channel by arithmetic, the lexical by similarity.

A case holds its own sources, so its anchors need nothing from any other row: this is a
projection, with no shuffle at all, that runs the same in batches and in streams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from ..functions import scan
from ..functions.columns import STRINGS
from ..functions.encoders import Encoder, Tokens, embed, scorable

SPAN = "struct<start:int,end:int>"
ANCHOR = f"struct<text:string,span:{SPAN},kind:string,support:double,value:string,evidence_id:string,evidence_text:string,evidence_span:{SPAN},notes:array<string>>"
FOUND = f"struct<anchors:array<{ANCHOR}>,error:string>"


def _anchor(unit: scan.Unit, support: float, value=None, evidence=(None, None, None), notes: tuple = ()) -> dict:
    source, text, span = evidence
    return {"text": unit.text, "span": (unit.start, unit.end), "kind": unit.kind, "support": support, "value": value, "evidence_id": source, "evidence_text": text, "evidence_span": span, "notes": [*unit.notes, *notes]}


class NumeralChannel:
    """A case's source numerals in order: by value, and as floats for distances."""

    def __init__(self, sources: list[tuple[str, str]], locale: str):
        found = [(source, n) for source, text in sources for n in scan.numerals(text, locale)]
        self.first: dict[str, int] = {}
        self.found = found
        for i, (_, n) in enumerate(found):
            for r in n.readings:
                self.first.setdefault(r, i)
        self.owner = np.array([i for i, (_, n) in enumerate(found) for _ in n.readings], int)
        self.value = np.array([float(r) for _, n in found for r in n.readings], float)

    def anchor(self, unit: scan.Unit) -> dict:
        own = [self.first[r] for r in unit.readings if r in self.first]
        at = min(own) if own else self.nearest(unit.readings[0])
        evidence = (None, None, None) if at is None else (self.found[at][0], self.found[at][1].text, (self.found[at][1].start, self.found[at][1].end))
        return _anchor(unit, float(bool(own)), " | ".join(unit.readings), evidence, ("numeral_ambiguous",) if len(unit.readings) > 1 else ())

    def nearest(self, reading: str) -> int | None:
        """The first of the source numerals with the least relative distance."""
        if not len(self.value):
            return None
        v = float(reading)
        with np.errstate(all="ignore"):
            far = np.abs(self.value - v) / np.maximum(np.maximum(np.abs(self.value), abs(v)), 1)
        return int(self.owner[int(np.argmin(np.nan_to_num(far, nan=np.inf)))])


class LexicalChannel:
    """A case's tokens: of the answer, and of each source with a text those that may be evidence."""

    def __init__(self, answer: str, sources: list[tuple[str, str]], encoder: Encoder):
        self.answer = embed(answer, encoder)
        self.starts, self.ends = np.array([s for s, _ in self.answer.spans]), np.array([e for _, e in self.answer.spans])
        self.sources: list[tuple[str, str, Tokens, list[int]]] = []
        for source, text in sources:
            if text:
                tokens = embed(text, encoder)
                self.sources.append((source, text, tokens, scorable(text, tokens)))
        self.near = [self.answer.vectors @ t.vectors[use].T if use and len(self.answer.spans) else None for _, _, t, use in self.sources]

    def anchor(self, unit: scan.Unit) -> dict:
        rows = np.flatnonzero((self.starts < unit.end) & (self.ends > unit.start)) if len(self.answer.spans) else ()
        if not len(rows):
            raise ValueError(f"word {unit.text!r} at {unit.start} meets no token of the answer")
        best, evidence, place = 0.0, (None, None, None), None
        for (source, text, tokens, use), near in zip(self.sources, self.near, strict=True):
            if near is None:
                continue
            s = np.round(near[rows], 9)
            at = int(np.argmax(s))
            support = float(min(1.0, max(0.0, s.flat[at])))
            if place is None or support > best:
                a, b = scan.expanded(text, *tokens.spans[use[at % s.shape[1]]])
                best, evidence, place = support, (source, text[a:b], (a, b)), text
        note = place is not None and scan.holds_word(unit.text, place)
        return _anchor(unit, best, None, evidence, ("exact_string_in_span",) * note)


def anchors_of(answer: str, sources: list[tuple[str, str]], locale: str, encoder: Encoder | None, most: int) -> list[dict]:
    """All anchors of one answer in its order; texts are in normal form. Without an encoder words have no evidence."""
    units = scan.units(answer, locale)
    kinds = [u.kind for u in units]
    if len(units) - kinds.count("skipped") > most:
        raise ValueError(f"answer has {len(units) - kinds.count('skipped')} scoring words, more than max_anchors={most}; raise it on purpose, or split the answer")
    numeral = NumeralChannel(sources, locale) if "numeral" in kinds else None
    lexical = LexicalChannel(answer, sources, encoder) if encoder and "lexical" in kinds else None
    out = []
    for u in units:
        if u.kind == "skipped":
            out.append(_anchor(u, 1.0))
        elif u.kind == "numeral":
            out.append(numeral.anchor(u))
        else:
            out.append(lexical.anchor(u) if lexical else _anchor(u, 0.0))
    return out


def anchors(answer: Column, sources: Column, locale: Column, encoder: Encoder | None, most: int = 2048) -> Column:
    """{anchors, error} of a case; a case that can't be answered has a null and says why."""

    @arrow_udf(FOUND)
    def run(answers: pa.Array, sources: pa.Array, locales: pa.Array) -> pa.Array:
        found, errors = [], []
        for a, s, x in zip(answers.to_pylist(), _pairs(sources), locales.to_pylist(), strict=True):
            try:
                found.append(anchors_of(a or "", s, x, encoder, most))
                errors.append(None)
            except ValueError as e:
                found.append(None)
                errors.append(str(e))
        return pa.StructArray.from_arrays([_arrow(found), pa.array(errors, pa.string())], ["anchors", "error"])

    return run(answer, sources, locale)


def _pairs(sources: pa.ListArray) -> Iterator[list[tuple[str, str]]]:
    """Each case's (id, text); none for a null."""
    all_of = sources.flatten()
    pairs = iter(zip(all_of.field("id").to_pylist(), all_of.field("text").to_pylist(), strict=True))
    for n in sources.value_lengths().to_pylist():
        yield [next(pairs) for _ in range(n or 0)]


def _spans(pairs: list[tuple[int, int] | None]) -> pa.StructArray:
    ends = [pa.array((p and p[i] for p in pairs), pa.int32()) for i in (0, 1)]
    return pa.StructArray.from_arrays(ends, ["start", "end"], mask=ends[0].is_null())


def _arrow(found: list[list[dict] | None]) -> pa.ListArray:
    """Anchors of a batch of cases, field by field."""
    flat = [a for anchors in found for a in anchors or ()]
    offsets = np.cumsum([0, *(len(anchors or ()) for anchors in found)])
    kinds = {"text": pa.string(), "kind": pa.string(), "support": pa.float64(), "value": pa.string(), "evidence_id": pa.string(), "evidence_text": pa.string(), "notes": STRINGS}
    names = ["text", "span", "kind", "support", "value", "evidence_id", "evidence_text", "evidence_span", "notes"]
    fields = [pa.array((a[n] for a in flat), kinds[n]) if n in kinds else _spans([a[n] for a in flat]) for n in names]
    missing = np.array([anchors is None for anchors in found] + [False])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=missing), pa.StructArray.from_arrays(fields, names))
