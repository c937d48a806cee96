"""Toxicity: a sparse linear classifier with counterfactual regularisation.

Features are the distinct words of a text (letters only, lower-cased) and their
beginnings of 3 to 6 letters, among those of the training sample.  Every labelled sentence that names an identity
group is copied with the group's name swapped for another one, and the squared
change of the logit between a text and its copy is penalised; the names
themselves then carry (nearly) equal weights, which the sparsity penalty draws to
zero, so a neutral mention of a group moves no score.  The sparsity penalty also
sets the many chance words of long texts to zero, so length alone moves none.

Defined cases: NULL and empty texts get the score of the intercept; without
training rows, or with one class only, every text gets that class's rate (0
without rows); repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from weekpanel.llm.sampling import WordRows, labelled, sigmoid, temperature
from weekpanel.llm.text import LETTER, release

# Names of groups, by kind; a name is swapped within its kind.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("black", "white", "asian", "latino", "arab"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("africans", "americans", "europeans", "mexicans", "chinese", "indians"),
    ("old", "young"),
    ("deaf", "blind", "disabled"),
)
KIND = {term: kind for kind in IDENTITY_TERMS for term in kind}


PREFIXES = (3, 4, 5, 6)


def core(word: bytes) -> str:
    return "".join(LETTER.findall(word.decode("utf-8", "replace"))).lower()


def features(core_: str) -> list[str]:
    """The word and its beginnings, which stay when a word is inflected."""
    return [core_, *(f"^{core_[:k]}" for k in PREFIXES if len(core_) >= k)] if core_ else []


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    temp: float = 1.0
    constant: float | None = None

    def _make(self, words: list[bytes]) -> np.ndarray:
        return np.array([[any(f in self.weights for f in features(core(w)))] for w in words], np.float32)

    def cache(self) -> WordRows:
        return WordRows(self._make, 1)

    def logit(self, text: str | None, cache: WordRows) -> float:
        words = text.encode().split() if text else []
        at = cache.of(words)
        hit = np.flatnonzero(cache.table[at, 0]) if len(at) else at
        found = {f for k in hit for f in features(core(words[k]))}  # a feature counts once a text
        return self.bias + sum(self.weights[f] for f in sorted(found) if f in self.weights)

    def score(self, texts, cache: WordRows) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return sigmoid(np.array([self.logit(t, cache) for t in texts], np.float64) / self.temp)


def swaps(words: list[set[str]], seed: int = 11) -> list[tuple[str, str]]:
    """``(name, other name)`` for every group name in a labelled text, and for
    neighbouring names of each kind once, so that names the sample lacks count too."""
    rng = np.random.default_rng(seed)
    out = [pair for kind in IDENTITY_TERMS for pair in zip(kind, kind[1:], strict=False)]
    for found in words:
        for term in sorted(found & KIND.keys()):
            others = [t for t in KIND[term] if t != term]
            out.append((term, others[rng.integers(len(others))]))
    return out


def train(texts: list[str], y: np.ndarray, evidence: float = 2.5, swap_weight: float = 1.0, ridge: float = 1e-5, steps: int = 200) -> ToxicityModel:
    """Accelerated proximal gradient on log loss + swap penalty + L1.

    The L1 weight asks for the evidence of more than ``evidence`` texts, however many
    texts there are.  Features whose gradient at the intercept-only model is under
    half of it are left out at once: they would be set to zero."""
    y = np.asarray(y, np.float64)
    if len(y) == 0 or len(np.unique(y)) < 2:
        return ToxicityModel(constant=float(y.mean()) if len(y) else 0.0)
    sparsity = evidence / len(y)
    number: dict[str, int] = {}
    of_word: dict[bytes, tuple[int, ...]] = {}

    def numbers(word: bytes) -> tuple[int, ...]:
        got = of_word.get(word)
        if got is None:
            got = of_word[word] = tuple(number.setdefault(f, len(number)) for f in features(core(word)))
        return got

    present = [np.unique(np.array([i for w in set(t.encode().split()) for i in numbers(w)], np.int32)) for t in texts]
    named = [{c for w in set(t.encode().split()) if (c := core(w)) in KIND} for t in texts]
    doc = np.repeat(np.arange(len(y)), [len(p) for p in present])
    col = np.concatenate(present).astype(np.int64)
    b = float(np.log(y.mean() / (1 - y.mean())))
    first = np.bincount(col, ((1 / (1 + np.exp(-b)) - y) / len(y))[doc], len(number))
    names = list(number)
    vocab = [names[i] for i in np.flatnonzero(np.abs(first) > sparsity / 2)]
    if not vocab:
        return ToxicityModel(bias=b)
    new = np.cumsum(np.abs(first) > sparsity / 2) - 1
    use = np.abs(first[col]) > sparsity / 2
    doc, col = doc[use], new[col[use]]
    at = {f: i for i, f in enumerate(vocab)}
    pairs = swaps(named)
    change = np.zeros((len(pairs), len(vocab)))  # a copy's features less the text's own
    for i, (x, z) in enumerate(pairs):
        for sign, name in ((-1, x), (1, z)):
            for f in features(name):
                if f in at:
                    change[i, at[f]] += sign
    change = change[np.abs(change).any(axis=1)]
    back = np.zeros(len(y), bool)
    back[np.random.default_rng(2).permutation(len(y))[: len(y) // 5]] = True
    use = np.where(back, 0.0, 1.0) / max(1, (~back).sum())

    def logits(w, b):
        return np.bincount(doc, w[col], len(y)) + b

    def loss(w, b):
        swap = swap_weight * np.mean((change @ w) ** 2) if len(change) else 0.0
        return float((np.logaddexp(0, -(2 * y - 1) * logits(w, b)) * use).sum() + swap)

    def grad(w, b):
        g = (sigmoid(logits(w, b)) - y) * use
        gw = np.bincount(col, g[doc], len(vocab))
        if len(change):
            gw += 2 * swap_weight * change.T @ (change @ w) / len(change)
        return gw, g.sum()

    w = v = np.zeros(len(vocab))
    c, rate, t = b, 1.0, 1.0
    for _ in range(steps):
        gw, gb = grad(v, c)
        here = loss(v, c)
        while True:  # backtracking line search
            step = v - rate * gw
            new_w = np.sign(step) * np.maximum(0, np.abs(step) - rate * sparsity)
            new_b = c - rate * gb
            dw, db = new_w - v, new_b - c
            if rate < 1e-6 or loss(new_w, new_b) <= here + gw @ dw + gb * db + (dw @ dw + db * db) / (2 * rate) + 1e-12:
                break
            rate /= 2
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new_w + (t - 1) / nt * (new_w - w)
        c = new_b + (t - 1) / nt * (new_b - b)
        moved = np.abs(new_w - w).max()
        w, b, t, rate = new_w, new_b, nt, rate * 1.5
        if moved < 1e-3:
            break
    # The L1 weight also shortens what it keeps; the kept features are fitted again with a small ridge.
    kept = np.flatnonzero(np.abs(w) > 1e-3)
    if len(kept):
        place = np.full(len(vocab), -1)
        place[kept] = np.arange(len(kept))
        on = place[col] >= 0
        x = np.ones((len(y), len(kept) + 1))
        x[:, :-1] = 0
        x[doc[on], place[col[on]]] = 1
        # The ridge holds the intercept too: texts without a kept feature all sit on it, and it would drift off.
        pull = 2 * ridge * np.eye(len(kept) + 1)
        if len(change):
            pull[:-1, :-1] += 2 * swap_weight * change[:, kept].T @ change[:, kept] / len(change)
        v = np.append(w[kept], b)
        share = np.where(y == 1, use / (2 * (use * y).sum()), use / (2 * (use * (1 - y)).sum()))  # both classes weigh alike
        for _ in range(40):  # Newton steps
            p = sigmoid(x @ v)
            g = x.T @ ((p - y) * share) + pull @ v
            step = np.linalg.solve((x * (p * (1 - p) * share)[:, None]).T @ x + pull, g)
            v -= step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
            if np.abs(step).max() < 1e-5:
                break
        w = np.zeros(len(vocab))
        w[kept], b = v[:-1], float(v[-1])
    # Calibration: an even score lies a quarter of the way from nearly all neutral to nearly all toxic texts,
    # so that one clear insult in a long text is enough.
    z = logits(w, b)
    neutral, toxic = np.quantile(z[y == 0], 0.999), np.quantile(z[y == 1], 0.01)
    if toxic > neutral:
        b -= neutral + (toxic - neutral) / 4
    temp = temperature(logits(w, b)[back], y[back])
    return ToxicityModel({vocab[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-6)}, float(b), temp)


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = 5000) -> ToxicityModel:
    """A model fitted on at most ``most`` labelled rows; ``labels`` has ``doc_id, toxic``."""
    got = labelled(docs, labels, "toxic", most=most)
    model = train(list(got.pop("text")), got["y"].to_numpy())
    release()
    return model
