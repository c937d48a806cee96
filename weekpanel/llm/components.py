"""Connected components of an edge table by stars, without moving it to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.text import lean
from weekpanel.session import materialize, scratch_scope

BUFFER = 2_000_000  # edges that a task holds at once
STARS = "a long, b long, moved boolean"


def stars_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of some edges as stars: every node but the smallest of its component, with the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    own = np.arange(len(nodes))
    up = own.copy()
    while True:
        p, q = up[x], up[y]
        open_ = p != q
        if not open_.any():
            break
        x, y, p, q = x[open_], y[open_], p[open_], q[open_]
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while (up != up[up]).any():
            up = up[up]
    leaf = up != own
    return nodes[leaf], nodes[up[leaf]]


def _partial(buffer: int):
    """Edges of a task as stars, at most about ``buffer`` edges together; ``moved`` is true if any edge of the task is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, moved = [], 0, False

        def emit():
            a, b = stars_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
            for i in range(0, len(a), 100_000):
                one, two = a[i : i + 100_000], b[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(np.full(len(one), moved))], ["a", "b", "moved"])
            held.clear()

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            moved |= bool(batch.column(2).to_numpy(zero_copy_only=False).any())
            size += batch.num_rows
            if size >= buffer:
                yield from emit()
                size = 0
        if held:
            yield from emit()

    return run


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges ``(a, b)`` with ``b < a``.

    ``moved`` marks edges that are not yet of a star: ``b`` has a smaller neighbour, or ``a`` has several."""
    least = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
    large = edges.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("moved"))
    large = large.groupBy("a", "b").agg(F.max("moved").alias("moved"))
    least = large.groupBy("a").agg(F.min("b").alias("m"), (F.count(F.lit(1)) > 1).alias("several"))
    small = large.join(least, "a")
    ends = F.array(F.struct(F.col("a").alias("a")), F.struct(F.col("b").alias("a")))
    small = small.select(F.inline(ends), "m", (F.col("moved") | F.col("several")).alias("moved")).filter("a <> m")
    return small.groupBy("a", F.col("m").alias("b")).agg(F.max("moved").alias("moved"))


def connected_components(edges: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """``(node, component)`` for every node (a long) of ``edges(a, b)``; the component is the smallest node reachable.

    Tasks first replace the edges they hold (at most about ``buffer``) by stars, a partial aggregation.  Rounds
    then link every larger neighbour of a node, and after that every smaller one, to the smallest; each round's
    edges go through the tasks' stars again.  They end when all edges form stars, whose centres are the
    components; there is no cap on rounds.  A hub's edges are combined map-side or meet one row of the hub, which the
    adaptive join splits.  Edges with a NULL end are left out; repeated edges and loops are harmless."""
    with scratch_scope(edges.sparkSession) as scope:
        given = materialize(edges.select("a", "b").dropna().distinct(), "edges")
        nodes = given.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        stars = given.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.lit(True).alias("moved"))
        stars = materialize(stars.filter("a <> b").mapInArrow(lean(_partial(buffer)), STARS), "stars")
        while not stars.filter("moved").isEmpty():
            stars = materialize(_round(stars.select("a", "b")).mapInArrow(lean(_partial(buffer)), STARS), "stars")
        found = nodes.join(stars.select(F.col("a").alias("node"), "b"), "node", "left")
        return scope.result(found.select("node", F.coalesce("b", "node").alias("component")), "components")
