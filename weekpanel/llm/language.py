"""Language identification: averaged hashed subword embeddings and a linear
softmax, trained by stochastic gradient descent in numpy.

A word's subwords are its character 1- to 4-grams with word marks and the word
itself, hashed into ``buckets`` rows of ``width`` numbers.  A text is the average
over the subwords of all its words.  Since the classifier is linear, each word has
fixed class sums, so scoring adds one small row per word of the whole text.
Probabilities are calibrated by a temperature on rows kept back from training.

Rejection is calibrated on the same rows, by two measures.  ``known`` is the share of a
text's 3- and 4-grams that occur in training texts (a bitmap of fixed size): a softmax
over learned languages says nothing of a text in another one, whose subwords are mostly
new.  A text is rejected if its known share is below that which all but ``miss`` of the
kept-back rows reach, less a tenth, or its probability below that which all but ``miss``
of those predicted right reach.

Defined cases: a text that is NULL or has no letter is ``und`` with score 0; with
no training rows every text is ``und``; ties go to the first language in
alphabetical order; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.sampling import Adam, WordRows, bounded_sample, temperature
from weekpanel.llm.text import mix, release, small_batches

UND = "und"


SIZES = (1, 2, 3, 4)


@lru_cache(1)
def _letters() -> np.ndarray:
    """True at code points that are letters, and at the blank that parts words."""
    out = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    out[0x20] = True
    return out


SEEN_BITS = 1 << 21


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, slice]:
    """``(word number, hash)`` of every subword of the words: the 1- to 4-grams of
    the lower-cased letters with a mark (a blank) on both sides, and the whole word.
    The slice holds the 3- and 4-grams."""
    text = " " + b" ".join(words).decode("utf-8", "replace").lower() + " "
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    code = code[_letters()[code]].astype(np.uint64)
    blank = code == 0x20
    number = np.cumsum(blank) - 1  # a blank opens the word after it
    after = np.concatenate([[0], np.cumsum(blank)])
    owners, hashes, sizes = [], [], [0] * len(SIZES)
    for n in SIZES:
        m = len(code) - n + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint64(n))
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[k : k + m]
        # no blank inside, and not a blank alone
        inside = after[np.arange(m) + n - 1] - after[np.arange(m) + 1] if n > 2 else np.zeros(m, int)
        ok = (inside == 0) & ~(blank[:m] & blank[n - 1 :])
        owners.append(number[:m][ok])
        hashes.append(h[ok])
        sizes[n - 1] = len(hashes[-1])
    letters = np.flatnonzero(~blank)
    if len(letters):  # whole words: a polynomial hash over each run of letters
        starts = np.flatnonzero(np.diff(number[letters], prepend=-1))
        place = np.arange(len(letters)) - np.repeat(starts, np.diff([*starts, len(letters)]))
        power = np.cumprod(np.full(place.max() + 1, np.uint64(0xC2B2AE3D27D4EB4F)))
        owners.append(number[letters][starts])
        hashes.append(np.add.reduceat(code[letters] * power[place], starts))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), slice(0, 0)
    return np.concatenate(owners), mix(np.concatenate(hashes)), slice(sum(sizes[:2]), sum(sizes))


def _places(hashes: np.ndarray, most: int) -> np.ndarray:
    return (hashes % np.uint64(most)).astype(np.int64)


def _marked(hashes: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """1 for every hash that the bitmap holds."""
    at = _places(hashes >> np.uint64(20), SEEN_BITS)
    return (seen[at >> 3] >> (at & 7).astype(np.uint8)) & 1


@dataclass
class LanguageModel:
    """``rows`` holds each bucket's class sums (embedding times output weights)."""

    langs: list[str]
    rows: np.ndarray
    bias: np.ndarray
    temp: float
    reject_below: float
    seen: np.ndarray
    known_below: float

    def _make(self, words: list[bytes]) -> np.ndarray:
        """Per word its class sums, its subwords, its 3- and 4-grams and the known ones of these."""
        owner, hashes, longer = subwords(words)
        ids, k = _places(hashes, len(self.rows)), len(self.langs)
        out = np.empty((len(words), k + 3), np.float32)
        for c in range(k):
            out[:, c] = np.bincount(owner, self.rows[ids, c], len(words))
        out[:, k] = np.bincount(owner, minlength=len(words))
        out[:, k + 1] = np.bincount(owner[longer], minlength=len(words))
        out[:, k + 2] = np.bincount(owner[longer], _marked(hashes[longer], self.seen), len(words))
        return out

    def cache(self) -> WordRows:
        return WordRows(self._make, len(self.langs) + 3)

    def predict(self, texts, cache: WordRows) -> tuple[list[str], list[float], list[float]]:
        """Names, probabilities and known shares."""
        names, scores, known, k = [], [], [], len(self.langs)
        for text in texts:
            words = text.encode().split() if text else []
            at = cache.of(words)
            total = cache.table[at].sum(axis=0, dtype=np.float64) if len(at) else np.zeros(k + 3)
            if not self.langs or total[k] == 0:
                names.append(UND)
                scores.append(0.0)
                known.append(0.0)
                continue
            z = (total[:k] / total[k] + self.bias) / self.temp
            p = np.exp(z - z.max())
            best = int(np.argmax(p))
            names.append(self.langs[best])
            scores.append(float(p[best] / p.sum()))
            known.append(float(total[k + 2] / max(1.0, total[k + 1])))
        return names, scores, known


def train(texts: list[str], langs: list[str], buckets: int = 1 << 15, width: int = 16, epochs: int = 4,
          miss: float = 0.002, seed: int = 3) -> LanguageModel:
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((1, 0), np.float32), np.zeros(0), 1.0, 0.0, np.zeros(SEEN_BITS // 8, np.uint8), 0.0)
    rng = np.random.default_rng(seed)
    rows, longer = [], []
    for t in texts:
        _, hashes, some = subwords(t.encode().split())
        u, c = np.unique(_places(hashes, buckets), return_counts=True)
        rows.append((u, (c / max(1, c.sum())).astype(np.float32)))
        longer.append(np.unique(hashes[some], return_counts=True))
    y = np.array([names.index(x) for x in langs])
    use = np.array([i for i, r in enumerate(rows) if len(r[0])], np.int64)
    rng.shuffle(use)
    back, fit = use[: len(use) // 5], use[len(use) // 5 :]
    emb = rng.normal(0, 0.1, (buckets, width)).astype(np.float32)
    out = rng.normal(0, 0.1, (width, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    adam = Adam([out, bias], 0.02)

    def pooled(batch):
        ids = np.concatenate([rows[i][0] for i in batch])
        weight = np.concatenate([rows[i][1] for i in batch])
        cut = np.cumsum([0, *[len(rows[i][0]) for i in batch[:-1]]])
        return ids, weight, cut, np.add.reduceat(emb[ids] * weight[:, None], cut, axis=0)

    rate = 3.0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // 32)):
            if not len(batch):
                continue
            ids, weight, cut, h = pooled(batch)
            z = h @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p /= len(batch)
            back_h = np.repeat(p @ out.T, np.diff([*cut, len(ids)]), axis=0)
            adam.step([h.T @ p, p.sum(axis=0)])
            np.subtract.at(emb, ids, rate * len(batch) * back_h * weight[:, None])
        rate *= 0.7
    logits = np.vstack([pooled(b)[3] @ out + bias for b in np.array_split(back, max(1, len(back) // 64)) if len(b)]) if len(back) else np.zeros((0, len(names)))
    temp = temperature(logits, y[back], 0.01)
    z = logits / temp
    p = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
    p = p / p.sum(axis=1, keepdims=True) if len(z) else p
    right = p.max(axis=1)[p.argmax(axis=1) == y[back]] if len(z) else np.zeros(0)
    reject = float(np.quantile(right, miss)) if len(right) and len(names) > 1 else 0.0
    held = np.zeros(SEEN_BITS, bool)
    for i in fit:
        held[_places(longer[i][0] >> np.uint64(20), SEEN_BITS)] = True
    seen = np.packbits(held, bitorder="little")
    known = [float((_marked(h, seen) * n).sum() / n.sum()) for h, n in (longer[i] for i in back) if len(h)]
    known_below = 0.9 * float(np.quantile(known, miss)) if known else 0.0
    return LanguageModel(names, emb @ out, bias.astype(np.float64), temp, reject, seen, known_below)


def fit_language(docs: DataFrame, most: int = 3000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """A model fitted on at most ``most`` rows of ``docs`` that have a language."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    got = bounded_sample(rows, id_col, [F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")], most)
    model = train(list(got.pop("text")), list(got["lang"]))
    release()
    return model


def language_of(docs: DataFrame, model: LanguageModel, text: Column) -> Column:
    """``struct(lang_pred, score, rejected)`` of a text column."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        cache = m.cache()
        for texts in batches:
            names, scores, known = m.predict(texts, cache)
            p = np.array(scores)
            out = np.array([n == UND for n in names]) | (p < m.reject_below) | (np.array(known) < m.known_below)
            yield pd.DataFrame({"lang_pred": names, "score": p, "rejected": out})
        del cache
        release()

    return judge(text)
