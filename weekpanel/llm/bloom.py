"""Blocked Bloom filter built by Spark and probed in Arrow batches.

A key's first hash picks one block of eight 32-bit words, its second hash picks
one bit in each word, so a probe touches one 32-byte line.  The number of blocks
is a parameter: the filter's size is fixed however many keys it holds, and more
keys only raise the share of false positives, which callers remove by an exact
join.  There are no false negatives.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = 1 << 16  # 2 MB; about 10 bits a key at 1.6 million keys
WORDS = 8


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit("bits"))


def build(keys: DataFrame, column: str, blocks: int = BLOCKS) -> np.ndarray:
    """The filter of all non-null keys, ``(blocks, 8)`` uint32.  Bits are combined
    per block on the executors; at most ``blocks`` rows reach the driver."""
    h1, h2 = _hashes(F.col(column))
    bits = [F.expr(f"bit_or(shiftleft(1, cast(shiftright(b, {5 * i}) & 31 AS int)))").alias(f"w{i}") for i in range(WORDS)]
    rows = (
        keys.filter(F.col(column).isNotNull())
        .select(F.pmod(h1, F.lit(blocks)).cast("int").alias("block"), h2.alias("b"))
        .groupBy("block")
        .agg(*bits)
        .toPandas()
    )
    out = np.zeros((blocks, WORDS), np.uint32)
    out[rows["block"].to_numpy()] = rows[[f"w{i}" for i in range(WORDS)]].to_numpy().astype(np.int64).astype(np.uint32)
    return out


def probe(filter_: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    lines = filter_[np.mod(h1, len(filter_))]
    hit = np.ones(len(h1), bool)
    for i in range(WORDS):
        hit &= (lines[:, i] >> ((h2 >> (5 * i)) & 31).astype(np.uint32)) & 1 == 1
    return hit


def maybe_listed(df: DataFrame, filter_: np.ndarray, key: Column) -> Column:
    """True where the filter may hold ``key``; False where it surely does not (NULL: False)."""
    shared = df.sparkSession.sparkContext.broadcast(filter_)

    @F.pandas_udf("boolean")
    def held(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(probe(shared.value, h1.to_numpy(np.int64), h2.to_numpy(np.int64)))

    return key.isNotNull() & held(*_hashes(key))
