"""Word rules shared by the operators: ASCII white space separates words, only
A-Z is lower-cased.  The column forms stay in the JVM; the byte forms are used
inside Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
LETTER = re.compile(r"[^\W\d_]")
SHINGLE = 5

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Odd multipliers of the rolling word-window hash (any fixed odd numbers do).
_MULT = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts hold ``BATCH_ROWS`` rows, not the default
    10,000: what a Python worker holds at once then stays a few MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def release() -> None:
    """Give memory that this process has freed back to the machine.  Python workers
    serve many tasks; without this each keeps the most that any task needed."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def lean(run):
    """A batch function that releases its memory when its task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


def ascii_lower(col: Column) -> Column:
    return F.translate(col, _UPPER, _UPPER.lower())


def word_column(col: Column) -> Column:
    """Array of the words of a text column; NULL text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), SPACE + "+"), "")


def window_hashes(words: str, size: int = SHINGLE) -> Column:
    """64-bit hashes of all ``size``-word windows of the array column named ``words``."""
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - F.lit(size))
    each = F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col(words), i + F.lit(k)) for k in range(size)]))
    return F.when(n >= size, each).otherwise(F.array().cast("array<bigint>"))


def remainder(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``: the fixed split of train and held-out
    rows.  -1 for a NULL id: such rows are never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(mod)), F.lit(-1))


def byte_words(text: bytes) -> list[bytes]:
    """``bytes.split()`` separates at exactly 0x20 and 0x09-0x0D; ``bytes.lower()`` changes A-Z only."""
    return text.lower().split()


def as_bytes(column) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


class WordHashes(dict):
    """word -> 64-bit hash, remembered; emptied when it holds ``most`` words, so memory is bounded."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a word-hash sequence.  Fewer than
    ``size`` words form one shingle; no words give an empty set."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(size, n)
    total = np.full(n - k + 1, np.uint64(k))
    for j in range(k):
        total += hashes[j : n - k + 1 + j] * _MULT[j]
    return np.unique(mix(total))


def signed(values: Iterable | np.ndarray) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)
