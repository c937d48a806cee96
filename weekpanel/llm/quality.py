"""Document quality: random-indexing word vectors pooled per document, then a
two-layer numpy network with temperature-calibrated probabilities.

Every word is a sum of pieces: its letters, each run of other characters, and a
mark for all-capitals.  A piece has a fixed sparse random index vector (drawn from
its hash; pieces the sample lacks share ``SHARED`` vectors, so no vocabulary of the
corpus is held); pieces seen in the training sample add the normalised sum of the
index vectors of the pieces around them.  A text is pooled
twice: the mean over all its words, and the largest and smallest means over its
blocks of 64 words, so that a bad passage in a long text stays visible.  A word
equal to the word before it adds the vector of a repetition mark.

Defined cases: NULL and empty texts are scored from zero vectors; without
training rows, or with one class only, every text gets that class's rate (0.5
without rows); repeated rows get equal scores.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.sampling import Adam, WordRows, labelled, sigmoid, temperature
from weekpanel.llm.text import release, small_batches

WIDTH, NONZERO, BLOCK, SHARED = 48, 6, 64, 4096
SAME = "<same>"
_RUNS = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")


def pieces(word: bytes) -> list[str]:
    out = []
    for run in _RUNS.findall(word.decode("utf-8", "replace")):
        if run[0].isalpha():
            out.append(run.lower())
            if len(run) > 1 and run.isupper():
                out.append("<caps>")
        elif run[0].isdigit():
            out.append("<number>")
        else:
            out.append(f"<{run[:4]}>")
    return out


def index_vector(piece: str) -> np.ndarray:
    """Sparse ternary vector from the piece's hash."""
    out = np.zeros(WIDTH, np.float32)
    h = xxhash.xxh3_128_intdigest(piece)
    for _ in range(NONZERO):
        h, at = divmod(h, WIDTH)
        out[at] += 1 if h & 1 else -1
        h >>= 1
    return out / np.sqrt(NONZERO)


def context_vectors(texts: list[str], most: int = 20_000, window: int = 2) -> dict[str, np.ndarray]:
    """Unit vectors of the ``most`` commonest pieces: sums of neighbours' index vectors."""
    known: dict[bytes, list[str]] = {}
    streams = [[p for w in t.encode().split() for p in (known.get(w) or known.setdefault(w, pieces(w)))] for t in texts]
    counts = Counter(p for s in streams for p in s)
    kept = [p for p, c in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most] if c > 1]
    at = {p: i for i, p in enumerate(kept)}
    base = np.vstack([index_vector(p) for p in kept] + [np.zeros(WIDTH, np.float32)])
    total = np.zeros_like(base)
    none = len(kept)
    buffer: list[int] = []

    def add():
        ids = np.array(buffer, np.int64)
        for d in range(1, window + 1):
            for x, y in ((ids[:-d], ids[d:]), (ids[d:], ids[:-d])):
                order = np.argsort(x, kind="stable")
                u, start = np.unique(x[order], return_index=True)
                total[u] += np.add.reduceat(base[y[order]], start, axis=0)

    for s in streams:
        buffer += [at.get(p, none) for p in s] + [none] * window
        if len(buffer) > 200_000:
            add()
            buffer = []
    if len(buffer) > window:
        add()
    size = np.linalg.norm(total, axis=1, keepdims=True)
    unit = total / np.maximum(size, 1e-6)
    return {p: unit[i] for p, i in at.items()}


@dataclass
class QualityModel:
    """``known`` numbers the sample's pieces; ``vectors`` has their rows, then the shared ones."""

    known: dict[str, int] = field(default_factory=dict)
    vectors: np.ndarray | None = None
    w1: np.ndarray | None = None
    b1: np.ndarray | None = None
    w2: np.ndarray | None = None
    b2: float = 0.0
    shift: np.ndarray | None = None
    scale: np.ndarray | None = None
    temp: float = 1.0
    constant: float | None = None

    @classmethod
    def of_context(cls, context: dict[str, np.ndarray]) -> QualityModel:
        rows = [index_vector(p) + v for p, v in context.items()] + [index_vector(f"shared {i}") for i in range(SHARED)]
        return cls({p: i for i, p in enumerate(context)}, np.vstack(rows).astype(np.float32))

    def row(self, piece: str) -> int:
        at = self.known.get(piece)
        return len(self.known) + xxhash.xxh32_intdigest(piece) % SHARED if at is None else at

    def _make(self, words: list[bytes]) -> np.ndarray:
        rows = [[self.row(p) for p in pieces(w)] for w in words]
        length = np.array([len(r) for r in rows])
        out = np.zeros((len(words), WIDTH), np.float32)
        full = np.flatnonzero(length)
        if len(full):
            start = np.cumsum(length[full]) - length[full]
            out[full] = np.add.reduceat(self.vectors[[i for r in rows for i in r]], start, axis=0)
        return out

    def cache(self) -> WordRows:
        return WordRows(self._make, WIDTH, most=60_000)

    def pooled(self, text: str | None, cache: WordRows) -> np.ndarray:
        at = cache.of(text.encode().split() if text else [])
        if not len(at):
            return np.zeros(3 * WIDTH, np.float32)
        start = np.arange(0, len(at), BLOCK)
        same = np.zeros(len(at), np.float32)
        same[1:] = at[1:] == at[:-1]
        total = np.add.reduceat(cache.table[at], start, axis=0)
        repeats = np.add.reduceat(same, start)
        total += repeats[:, None] * self.vectors[self.row(SAME)] * 2
        # short texts and last blocks are weighed as if filled up with empty words
        blocks = total / BLOCK
        return np.concatenate([total.sum(axis=0) / max(len(at), BLOCK), blocks.max(axis=0), blocks.min(axis=0)])

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(0, (x - self.shift) / self.scale @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

    def score(self, texts, cache: WordRows) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        x = np.vstack([self.pooled(t, cache) for t in texts]) if len(texts) else np.zeros((0, 3 * WIDTH), np.float32)
        return sigmoid(self.logits(x).astype(np.float64) / self.temp)


def train(texts: list[str], y: np.ndarray, hidden: int = 32, epochs: int = 30, decay: float = 1e-3, seed: int = 5) -> QualityModel:
    y = np.asarray(y, np.float32)
    if len(y) == 0 or len(np.unique(y)) < 2:
        return QualityModel(constant=float(y.mean()) if len(y) else 0.5)
    model = QualityModel.of_context(context_vectors(texts))
    cache = model.cache()
    x = np.vstack([model.pooled(t, cache) for t in texts])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    back, fit = order[: len(y) // 5], order[len(y) // 5 :]
    model.shift, model.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    model.w1 = rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)).astype(np.float32)
    model.b1 = np.zeros(hidden, np.float32)
    model.w2 = rng.normal(0, np.sqrt(1 / hidden), hidden).astype(np.float32)
    b2 = np.zeros(1, np.float32)
    xn = (x - model.shift) / model.scale
    adam = Adam([model.w1, model.b1, model.w2, b2], 0.005)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            if not len(batch):
                continue
            pre = xn[batch] @ model.w1 + model.b1
            h = np.maximum(0, pre)
            g = (sigmoid(h @ model.w2 + b2[0]) - y[batch]) / len(batch)
            gh = np.outer(g, model.w2) * (pre > 0)
            adam.step([xn[batch].T @ gh + decay * model.w1, gh.sum(axis=0), h.T @ g + decay * model.w2, g.sum(keepdims=True)])
    model.b2 = float(b2[0])
    model.temp = temperature(model.logits(x[back]).astype(np.float64), y[back])
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = 3000) -> QualityModel:
    """A model fitted on at most ``most`` labelled rows; ``labels`` has ``doc_id, quality``."""
    got = labelled(docs, labels, "quality", most=most)
    model = train(list(got.pop("text")), got["y"].to_numpy())
    release()
    return model


def score_column(docs: DataFrame, model, text: Column) -> Column:
    """The score (0 to 1) of a text column by any model with ``cache`` and ``score``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = shared.value.cache()
        for texts in batches:
            yield pd.Series(shared.value.score(list(texts), cache))
        del cache
        release()

    return judge(text)
