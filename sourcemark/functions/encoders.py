"""Token encoders: the interface, windows over it, and a deterministic one without a model."""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple, Protocol, runtime_checkable

import numpy as np

OVERLAP = 0.5


class WindowEncoding(NamedTuple):
    token_spans: tuple[tuple[int, int], ...]
    vectors: np.ndarray


@runtime_checkable
class Encoder(Protocol):
    """Anything with these four; it is pickled to the executors, so load models lazily."""

    @property
    def id(self) -> str: ...

    @property
    def max_tokens(self) -> int: ...

    def token_spans(self, text: str) -> tuple[tuple[int, int], ...]: ...

    def encode_window(self, text: str) -> WindowEncoding: ...


class Window(NamedTuple):
    offset: int
    text: str
    first_token: int
    last_token: int


class Tokens(NamedTuple):
    """Spans and unit vectors of a text's tokens, those in two windows twice."""

    spans: list[tuple[int, int]]
    vectors: np.ndarray


class TrigramEncoder:
    """Signed hashed character trigrams of sub-words of up to four characters; a vector depends on its sub-word alone."""

    SUBWORD, SIZE = 4, 64
    _WORD = re.compile(r"\w+|[^\w\s]")

    def __init__(self, max_tokens: int = 16):
        self.max_tokens = max_tokens
        self._known: dict[str, np.ndarray] = {}

    @property
    def id(self) -> str:
        return f"trigram-{self.SIZE}@v1"

    def __getstate__(self):
        return {"max_tokens": self.max_tokens, "_known": {}}

    def token_spans(self, text: str) -> tuple[tuple[int, int], ...]:
        return tuple((i, min(i + self.SUBWORD, m.end())) for m in self._WORD.finditer(text) for i in range(m.start(), m.end(), self.SUBWORD))

    def vector(self, piece: str) -> np.ndarray:
        key = f" {piece.lower()} "
        if key not in self._known:
            if len(self._known) > 200_000:
                self._known.clear()
            out = np.zeros(self.SIZE)
            for i in range(len(key) - 2):
                digest = hashlib.sha256(key[i : i + 3].encode()).digest()
                out[int.from_bytes(digest[:4], "big") % self.SIZE] += 1 if digest[4] % 2 else -1
            self._known[key] = out / (np.linalg.norm(out) or 1)
        return self._known[key]

    def encode_window(self, text: str) -> WindowEncoding:
        spans = self.token_spans(text)
        if len(spans) > self.max_tokens:
            raise ValueError(f"a window of {len(spans)} tokens is more than max_tokens={self.max_tokens}")
        return WindowEncoding(spans, np.array([self.vector(text[a:b]) for a, b in spans]).reshape(len(spans), self.SIZE))


class ModelEncoder:
    """Contextual vectors of a sentence-transformers model, loaded once in each worker; needs that package and the model's files."""

    SPECIAL = 2

    def __init__(self, name: str = "sentence-transformers/all-mpnet-base-v2", revision: str | None = None, max_tokens: int | None = None):
        self.name, self.revision, self._limit, self._model = name, revision, max_tokens, None

    def __getstate__(self):
        return self.__dict__ | {"_model": None}

    @property
    def model(self):
        if self._model is None:
            from sentence_transformers import SentenceTransformer

            self._model = SentenceTransformer(self.name, revision=self.revision)
        return self._model

    @property
    def id(self) -> str:
        return f"{self.name}@{self.revision or 'unresolved'}"

    @property
    def max_tokens(self) -> int:
        return max(1, (self._limit or self.model.max_seq_length or 384) - self.SPECIAL)

    def token_spans(self, text: str) -> tuple[tuple[int, int], ...]:
        found = self.model.tokenizer(text, return_offsets_mapping=True, add_special_tokens=False, truncation=False)
        return tuple((a, b) for a, b in found["offset_mapping"] if b > a)

    def encode_window(self, text: str) -> WindowEncoding:
        vectors = host_array(self.model.encode(text, output_value="token_embeddings"))
        spans = self.model.tokenizer(text, return_offsets_mapping=True, truncation=False)["offset_mapping"]
        use = [i for i, (a, b) in enumerate(spans) if b > a and i < len(vectors)]
        return WindowEncoding(tuple(tuple(spans[i]) for i in use), unit_rows(vectors[use]))


def host_array(x) -> np.ndarray:
    """float32 numpy from arrays, lists or tensors that may be on a device."""
    for step in ("detach", "cpu", "numpy"):
        if callable(getattr(x, step, None)):
            x = getattr(x, step)()
    return np.asarray(x, dtype=np.float32)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)).astype(np.float32)


def window_bounds(n: int, limit: int) -> list[tuple[int, int]]:
    """First and last token (exclusive) of windows of `limit` tokens that overlap by half; the last token ends the last."""
    if not n:
        return []
    out = [(0, min(n, limit))]
    while out[-1][1] < n:
        at = out[-1][0] + max(1, int(limit * OVERLAP))
        out.append((at, min(n, at + limit)))
    return out


def plan_windows(text: str, encoder: Encoder) -> list[Window]:
    spans, limit = encoder.token_spans(text), max(1, encoder.max_tokens)
    if 0 < len(spans) <= limit:
        return [Window(0, text, 0, len(spans))]
    return [Window(spans[a][0], text[spans[a][0] : spans[b - 1][1]], a, b) for a, b in window_bounds(len(spans), limit)]


def embed(text: str, encoder: Encoder) -> Tokens:
    """All tokens of a text through its windows; an encoder whose spans and vectors disagree is an error."""
    spans: list[tuple[int, int]] = []
    vectors = []
    for w in plan_windows(text, encoder):
        got = encoder.encode_window(w.text)
        if len(got.token_spans) != len(got.vectors):
            raise ValueError(f"{encoder.id} gave {len(got.token_spans)} spans and {len(got.vectors)} vectors")
        spans += [(a + w.offset, b + w.offset) for a, b in got.token_spans]
        vectors.append(np.asarray(got.vectors, dtype=float))
    return Tokens(spans, np.concatenate(vectors) if vectors else np.zeros((0, 0)))


def scorable(text: str, tokens: Tokens) -> list[int]:
    """Tokens with a letter or digit, or all if none has one."""
    some = [i for i, (a, b) in enumerate(tokens.spans) if any(map(str.isalnum, text[a:b]))]
    return some or list(range(len(tokens.spans)))
