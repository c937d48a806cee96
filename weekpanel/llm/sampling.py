"""Bounded training samples of labelled rows, and the shared fitting helpers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 8000  # rows a classifier is fitted on; every other step covers all rows


def bounded_sample(rows: DataFrame, key: str, columns: list[str | Column], most: int = SAMPLE_ROWS) -> pd.DataFrame:
    """At most ``most`` rows, those with the smallest hashes of ``key`` (the same
    rows in any order of partitions).  Only ``most`` hashes are compared on the
    driver; then the rows below the last of them are read."""
    order = F.xxhash64(F.lit("sample"), F.col(key))
    last = rows.select(order.alias("o")).orderBy("o").limit(most).agg(F.max("o")).first()[0]
    if last is None:
        return rows.select(*columns).limit(0).toPandas()
    return rows.filter(order <= last).orderBy(order, key).limit(most).select(*columns).toPandas()


def labelled(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", most: int = SAMPLE_ROWS) -> pd.DataFrame:
    """``text, y`` of a bounded sample of labelled documents.  The labels' hashes
    choose the sample first, so only its texts are joined; of rows that repeat an id the
    least text is taken.  Labels other than 0 and 1, null ids and null labels are left
    out; an id with both labels counts as 1."""
    good = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("y"))
    order = F.xxhash64(F.lit("sample"), F.col(key))
    last = good.select(order.alias("o")).orderBy("o").limit(most).agg(F.max("o")).first()[0]
    if last is None:
        return pd.DataFrame({"text": pd.Series([], dtype=object), "y": pd.Series([], dtype=np.int64)})
    texts = docs.select(F.col(key), F.coalesce("text", F.lit("")).alias("text")).filter(order <= last)
    one = texts.groupBy(key).agg(F.min("text").alias("text"))  # an id may fill a third of the table
    picked = one.join(good.filter(order <= last), key).select(key, "text", "y").toPandas()
    return picked.sort_values(key)[["text", "y"]].reset_index(drop=True)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def temperature(logits: np.ndarray, y: np.ndarray, least: float = 0.2) -> float:
    """The temperature from ``least`` to 8 that minimises held-back log loss (grid on a log scale)."""
    grid = np.exp(np.linspace(np.log(least), np.log(8), 60))
    if len(y) == 0 or len(np.unique(y)) < 2:
        return 1.0
    if logits.ndim == 1:
        losses = [np.mean(np.logaddexp(0, -(2 * y - 1) * logits / t)) for t in grid]
    else:
        losses = []
        for t in grid:
            z = logits / t
            z = z - z.max(axis=1, keepdims=True)
            losses.append(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]))
    return float(grid[int(np.argmin(losses))])


class Adam:
    """Adam steps for a list of arrays, in place."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= scale * m / (np.sqrt(v) + 1e-8)


class WordRows(dict):
    """word -> row of a growing table of per-word values; rows of new words are
    computed together by ``make(words) -> array``.  Emptied between texts once it
    holds ``most`` words, so memory is bounded."""

    def __init__(self, make, width: int, most: int = 100_000):
        super().__init__()
        self.make, self.most, self.new = make, most, []
        self.table = np.zeros((1024, width), np.float32)

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at

    def of(self, words: list[bytes]) -> np.ndarray:
        """Row numbers of the words; their values are then in ``table``."""
        if len(self) > self.most:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            start = len(self) - len(self.new)
            if len(self) > len(self.table):
                grown = np.zeros((max(len(self), 2 * len(self.table)), self.table.shape[1]), np.float32)
                grown[:start] = self.table[:start]
                self.table = grown
            self.table[start : len(self)] = self.make(self.new)
            self.new = []
        return at
