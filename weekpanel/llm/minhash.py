"""Near-duplicate groups by circulant MinHash.

Two permutations give every signature coordinate: the first permutes a shingle's
hash into ``0 .. UNIVERSE-1``, the second is one random table read at
``position + k`` for coordinate ``k``, so that coordinate ``k`` is the minimum
over the table shifted by ``k`` places.  Coordinates are banded, and links are
confirmed by the exact Jaccard similarity of full shingle sets.

Work per group of copies stays (nearly) linear:

* rows with equal sets collapse to one representative before any banding;
* for a few rounds each representative is verified against one centre of its
  buckets, and only buckets whose members still lie in different components stay;
* in those, members of different components are compared in numpy, block by block;
  a pair becomes a row only if it links two components.  Members that are already
  connected are never compared, and no pair of different components is left out.

Defined cases: NULL or blank text has an empty set and is linked with nothing;
fewer than five words form one shingle; rows without an id are returned unlinked
(component NULL, kept); rows that repeat an id belong together; an empty table
gives an empty result.  Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.llm import bloom
from weekpanel.llm.components import connected_components
from weekpanel.llm.text import WordHashes, as_bytes, byte_words, lean, mix, shingle_set, signed, small_batches
from weekpanel.session import materialize

UNIVERSE = 1 << 20
ROWS, BANDS = 4, 32  # a pair at similarity 0.75 misses all bands with probability (1 - 0.75^4)^32 = 5e-6
STARS = 3


class Circulant:
    """Signatures of ``rows * bands`` coordinates from two permutations."""

    def __init__(self, rows: int = ROWS, bands: int = BANDS, seed: int = 7):
        self.rows, self.bands, self.k = rows, bands, rows * bands
        table = np.random.default_rng(seed).permutation(UNIVERSE).astype(np.int32)
        ring = np.concatenate([table, table[: self.k]])
        self.shifted = np.lib.stride_tricks.sliding_window_view(ring, self.k)

    def signature(self, shingles: np.ndarray, chunk: int = 8192) -> np.ndarray:
        at = (mix(shingles + np.uint64(0x5851F42D4C957F2D)) & np.uint64(UNIVERSE - 1)).astype(np.int64)
        parts = [self.shifted[at[i : i + chunk]].min(axis=0) for i in range(0, len(at), chunk)]
        return parts[0] if len(parts) == 1 else np.min(parts, axis=0)

    def bands_of(self, signature: np.ndarray) -> np.ndarray:
        rows = signature.astype(np.uint64).reshape(self.bands, self.rows)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for j in range(self.rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
        return key


def _digest(shingles: np.ndarray) -> int:
    """The set's identity: rows of one digest are one class and one node of the link graph."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def _sketches(rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, circulant = WordHashes(), Circulant(rows, bands)
        for batch in batches:
            size, node, keys = [], [], []
            for text in as_bytes(batch.column(1)):
                s = shingle_set(words.of(byte_words(text or b"")))
                size.append(len(s))
                node.append(_digest(s))
                keys.append(signed(circulant.bands_of(circulant.signature(s))) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(signed(node)), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n", "node", "keys"],
            )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch in batches:
        sets = [shingle_set(words.of(byte_words(t or b""))) for t in as_bytes(batch.column(1))]
        node = pa.array(signed([_digest(s) for s in sets]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), node, pa.array([signed(s) for s in sets], pa.list_(pa.int64()))], ["rep", "node", "shingles"]
        )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets satisfy 100 * intersection >= percent * union."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(a, "a").join(b, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    near = both.select("a", "b", shared.alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return near.filter(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("a", "b")


def _sizes_fit(percent: int, x: str, y: str):
    """Sets of too different sizes cannot be similar enough (exact)."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _merging(percent: int):
    """Per block pair of one bucket: links between different components.

    Intersections are counted exactly, packed as bit rows over the shingles that two
    members share.  Of the similar pairs those that join two components not joined yet
    are returned (at most one per member), since others add nothing to the components."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node, label, size, side = (group.column(c).to_numpy() for c in ("node", "l", "n", "side"))
        shingles = group.column("shingles").combine_chunks()
        count = shingles.value_lengths().to_numpy()
        flat = shingles.flatten().to_numpy()
        row = np.repeat(np.arange(len(node)), count)
        _, col, times = np.unique(flat, return_inverse=True, return_counts=True)
        both = times > 1
        use = both[col]
        row, col = row[use], (np.cumsum(both) - 1)[col[use]]
        bits = np.zeros((len(node), int(both.sum()) // 64 + 1), np.uint64)
        np.bitwise_or.at(bits, (row, col >> 6), np.uint64(1) << (col & 63).astype(np.uint64))
        parent: dict[int, int] = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        names, per = np.unique(label, return_counts=True)
        most = names[per.argmax()]
        across = side.min() != side.max()
        a, b = [], []
        for i in np.flatnonzero(label != most):
            other = (label != label[i]) & ((label == most) | (node > node[i]))
            if across:
                other &= side != side[i]
            other &= 100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])
            at = np.flatnonzero(other)
            if not len(at):
                continue
            inter = np.bitwise_count(bits[at] & bits[i]).sum(axis=1, dtype=np.int64)
            for j in at[100 * inter >= percent * (size[at] + size[i] - inter)]:
                x, y = root(int(label[i])), root(int(label[j]))
                if x != y:
                    parent[x] = y
                    a.append(min(node[i], node[j]))
                    b.append(max(node[i], node[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _across_components(left: DataFrame, sets: DataFrame, percent: int, block: int = 400_000) -> DataFrame:
    """Candidate links inside buckets whose members lie in several components.

    A bucket is cut into blocks of about ``block`` shingles and each pair of blocks
    is one group, so no task holds a whole large bucket, and no pair becomes a row
    unless it is (nearly) a link between two components."""
    blocks = left.groupBy("key").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    cut = left.join(blocks, "key").withColumn("side", F.pmod(F.xxhash64("node", F.lit("block")), "blocks").cast("int"))
    dealt = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.join(sets.select(F.col("id").alias("node"), "shingles"), "node").select(
        "key", F.least("side", "with").alias("lo"), F.greatest("side", "with").alias("hi"), "node", "n", "l", "side", "shingles"
    )
    return dealt.groupBy("key", "lo", "hi").applyInArrow(_merging(percent), "a long, b long").distinct()


def near_links(reps: DataFrame, read: DataFrame, percent: int) -> DataFrame:
    """Verified links ``(a, b)`` between classes that give the components of all
    links.  ``reps`` has one row per class: ``node, rep, n, keys``."""
    buckets = reps.select("node", "rep", "n", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    member = materialize(buckets.join(shared, "key", "left_semi"), "buckets")
    if member.isEmpty():
        return member.select(F.col("node").alias("a"), F.col("node").alias("b"))
    # Sets are made anew for the documents that share a bucket; false positives of the filter go with the join.
    filter_ = bloom.build(member.select("rep").distinct(), "rep")
    wanted = read.filter(bloom.maybe_listed(read, filter_, F.col("doc_id")))
    sets = wanted.mapInArrow(lean(_sets), "rep long, node long, shingles array<long>")
    sets = materialize(sets.join(member.select("rep", "node").distinct(), ["rep", "node"], "left_semi"), "sets")
    sets = sets.select(F.col("node").alias("id"), "shingles")

    links = None
    left = member.select("key", "node", "n", F.col("node").alias("l"))
    for turn in range(STARS + 1):
        if turn < STARS:
            # Each member meets one centre: of its buckets' centres in other components, the first in this
            # round's order.  Members of one group so share few centres.
            mask = (turn * 0x5DEECE66D1234567) & 0x7FFFFFFFFFFFFFFF
            order = F.col("node").bitwiseXOR(F.lit(mask))
            centre = left.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("n").alias("nb"), F.col("l").alias("lc"))).alias("c"))
            met = left.join(centre, "key").filter((F.col("l") != F.col("c.lc")) & _sizes_fit(percent, "n", "c.nb"))
            pairs = met.groupBy(F.col("node").alias("x")).agg(F.min("c.o").bitwiseXOR(F.lit(mask)).alias("y"))
            pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        else:
            pairs = _across_components(left, sets, percent)
        found = materialize(_verified(pairs, sets, percent), "links")
        links = found if links is None else links.union(found)
        if turn == STARS:
            break
        now = member.join(connected_components(links).withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left")
        now = now.select("key", "node", "n", F.coalesce("component", "node").alias("l"))
        mixed = now.groupBy("key").agg(F.min("l").alias("lo"), F.max("l").alias("hi")).filter("lo <> hi").select("key")
        left = materialize(now.join(mixed, "key", "left_semi"), "open")
        if left.isEmpty():
            break
    return links


def near_duplicates(
    docs: DataFrame, percent: int = 75, rows: int = ROWS, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``."""
    small_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = materialize(read.mapInArrow(lean(_sketches(rows, bands)), "doc_id long, n long, node long, keys array<long>"), "sketches")
    usable = sketch.filter("n > 0 AND doc_id IS NOT NULL")
    classes = materialize(usable.groupBy("node").agg(F.min("doc_id").alias("rep")), "classes")
    reps = usable.join(classes.withColumnRenamed("rep", "doc_id"), ["node", "doc_id"])
    links = near_links(reps.select("node", F.col("doc_id").alias("rep"), "n", "keys").distinct(), read, percent)
    # an id that occurs with several texts ties their classes together
    per_id = usable.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z")
    ties = usable.join(per_id, "doc_id").filter("node <> a").select("a", F.col("node").alias("b"))
    comp = connected_components(links.union(ties)).withColumnRenamed("node", "m")
    named = classes.join(comp, F.col("node") == F.col("m"), "left").select("node", "rep", F.coalesce("component", "node").alias("l"))
    least = named.groupBy("l").agg(F.min("rep").alias("component_id"))
    of_class = materialize(named.join(least, "l").select("node", "component_id"), "components")
    out = sketch.drop("keys").join(of_class, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
