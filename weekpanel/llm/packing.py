"""Packing token sequences by non-negative least squares over length patterns.

Each document is tokenised once, in the task that reads it: its ids (with the end
id) are cut into full windows and one rest.  Lengths of rests are counted in
classes of ``GRAIN`` tokens, a histogram of fixed size.  On the driver, all
patterns of at most three classes that fill a window are enumerated, non-negative
least squares finds how often to repeat each so that the patterns use up the
histogram, the counts are rounded down, and the residual histogram is packed
greedily (largest class first, then the largest that still fits).  The plan's size
depends on the number of classes only.

Pieces get their rank within their class from per-partition counts (no sort of all
rows, no single-task window), the plan turns class and rank into a sequence and a
slot, and offsets are running sums within one sequence.

Defined cases: NULL or empty text is one piece that holds the end id alone; rows
that repeat an id are separate documents with the same id; an empty table gives an
empty result.  Only the id and the text are read.
"""

from __future__ import annotations

import base64
import binascii
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekpanel.llm.text import lean, small_batches
from weekpanel.session import materialize

WINDOW, GRAIN, END_ID = 2048, 16, 1
SPECIAL = "<|endoftext|>"  # the vocabulary's one special string


class Encoder:
    """Ids of a byte-level BPE vocabulary file.

    The merges run in tiktoken on the same vocabulary (about five times faster,
    equal ids); a text that holds the special string goes through the tokenizer
    file itself, which knows it."""

    def __init__(self, vocabulary: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(vocabulary.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("pack", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(vocabulary)

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text).astype(np.uint32) if text else np.zeros(0, np.uint32)


def _pieces(vocabulary: str, window: int, grain: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        end = np.array([END_ID], np.uint32)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([encoder.ids(text or ""), end])
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    kind = -(-len(piece) // grain)
                    rank = seen.get(kind, 0)
                    seen[kind] = rank + 1
                    rows.append((doc, start, len(piece), binascii.crc32(piece.astype("<u4").tobytes()), len(ids), kind, part, rank))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "part", "rank"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def patterns(classes: int) -> np.ndarray:
    """All multisets of at most three class sizes that sum to ``classes``, as counts per size."""
    rows = [(classes,)]
    rows += [(a, classes - a) for a in range(1, classes // 2 + 1)]
    rows += [(a, b, classes - a - b) for a in range(1, classes // 3 + 1) for b in range(a, (classes - a) // 2 + 1)]
    out = np.zeros((len(rows), classes))
    for i, r in enumerate(rows):
        for size in r:
            out[i, size - 1] += 1
    return out


def nnls(a: np.ndarray, y: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Active-set non-negative least squares: min |a x - y|, x >= 0."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    gram, target = a.T @ a, a.T @ y
    for _ in range(rounds):
        slope = target - gram @ x
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= 1e-9 * max(1.0, np.abs(target).max()):
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            part = gram[np.ix_(at, at)]
            z = np.linalg.solve(part + 1e-10 * np.trace(part) / len(at) * np.eye(len(at)), target[at])
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            share = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += share * (z - x[at])
            gone = at[(x[at] <= 1e-12) & low]
            if not len(gone):
                gone = at[low][:1]
            x[gone] = 0
            active[gone] = False
            if not active.any():
                break
    return x


def plan(histogram: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """``[(count per class, repeats)]`` that uses up the histogram of classes 1..n exactly."""
    n = len(histogram)
    left = histogram.astype(np.int64).copy()
    out: list[tuple[dict[int, int], int]] = []
    if left.sum() == 0:
        return out

    def use(counts: dict[int, int], repeats: int):
        if repeats > 0:
            out.append((counts, repeats))
            for k, c in counts.items():
                left[k - 1] -= c * repeats

    use({n: 1}, int(left[n - 1]))  # full windows
    shapes = patterns(n)[1:]
    if left.sum():
        # weights make the least-squares error count in tokens rather than in pieces
        weight = np.arange(1, n + 1) / n
        scale = left.max()
        repeats = np.floor(nnls((shapes * weight).T, left * weight / scale) * scale + 1e-6).astype(np.int64)
        for i in np.argsort(-repeats, kind="stable"):
            if repeats[i] <= 0:
                break
            counts = {int(k) + 1: int(shapes[i, k]) for k in np.flatnonzero(shapes[i])}
            use(counts, min(int(repeats[i]), *(int(left[k - 1]) // c for k, c in counts.items())))
    while left.sum():  # greedy: the largest class, then always the largest that fits
        counts: dict[int, int] = {}
        room = n
        while room and (fit := np.flatnonzero(left[:room] > [counts.get(k, 0) for k in range(1, room + 1)])).size:
            k = int(fit[-1]) + 1
            counts[k] = counts.get(k, 0) + 1
            room -= k
        use(counts, min(int(left[k - 1]) // c for k, c in counts.items()))
    return out


def _slots(steps: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per class: first rank, first sequence, pieces per sequence and first slot of each step."""
    taken: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for counts, repeats in steps:
        slot = 0
        for k, c in sorted(counts.items(), reverse=True):
            rows.setdefault(k, []).append((taken.get(k, 0), sequence, c, slot))
            taken[k] = taken.get(k, 0) + c * repeats
            slot += c
        sequence += repeats
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in rows.items()}


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, grain: int = GRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    small_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "part", "rank")
    cut = materialize(read.mapInArrow(lean(_pieces(vocabulary, window, grain)), ", ".join(f"{n} long" for n in names)), "pieces")
    sizes = cut.groupBy("kind", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(window // grain, np.int64)
    for row in sizes.groupBy("kind").agg(F.sum("n").alias("n")).collect():  # one row per class
        histogram[row["kind"] - 1] = row["n"]
    slots = cut.sparkSession.sparkContext.broadcast(_slots(plan(histogram)))

    before = F.coalesce(F.sum("n").over(Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.join(sizes.select("kind", "part", before.alias("before")), ["kind", "part"])

    @F.pandas_udf("sequence_id long, slot long")
    def place(kind: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, slot = np.empty(len(kind), np.int64), np.empty(len(kind), np.int64)
        kinds, ranks = kind.to_numpy(), rank.to_numpy()
        for k in np.unique(kinds):
            mine = kinds == k
            first, base, per, start = slots.value[int(k)]
            at = np.searchsorted(first, ranks[mine], side="right") - 1
            copy, within = np.divmod(ranks[mine] - first[at], per[at])
            sequence[mine], slot[mine] = base[at] + copy, start[at] + within
        return pd.DataFrame({"sequence_id": sequence, "slot": slot})

    placed = ranked.withColumn("p", place("kind", F.col("rank") + F.col("before")))
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("p.sequence_id").alias("sequence_id"), F.col("p.slot").alias("slot")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"),
    )
