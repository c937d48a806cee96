"""Benchmark decontamination in DataFrame functions only.

A benchmark item and a window of a document are compared as multisets of hashed
five-word shingles; a window is a copy if the weighted similarity (sum of the
smaller counts over sum of the larger) is at least 0.75.

1. One pass over the texts keeps the positions whose shingle may belong to an item
   (a bitmap of fixed size, no false negatives).  A window without enough of them
   cannot be similar, so the rest of the corpus is never fingerprinted.  Positions
   closer than the longest item form a region.
2. Windows of every item size (classes of 10 %) start at the hits of a region: a
   similar window can be moved to its first shared shingle and keeps its
   similarity.  Running sums per fingerprint bit give each window's 64-bit SimHash.
3. Six blocks of the fingerprint index the items within two flipped bits a block,
   which holds every item within Hamming distance 17 (pigeonhole).
4. Candidates are verified with the exact weighted similarity at the item's size.

Defined cases: NULL, empty and short texts have no window; an item of fewer than
five words has no shingle and matches nothing; an empty benchmark matches nothing;
repeated documents are reported once per id; rows without an id are searched and
reported with a NULL id.  Only the id and text columns of both tables are read.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekpanel.llm.text import SHINGLE, window_hashes
from weekpanel.session import materialize

BITMAP_BITS = 1 << 20
BITS, LANES, LANE = 64, 3, 21  # three counters of 21 bits in each of 22 longs
BLOCKS = (11, 11, 11, 11, 10, 10)
FLIPS = 2
RADIUS = (FLIPS + 1) * len(BLOCKS) - 1
GROWTH = 1.1
SPAN = 1 << 20  # a counter of 21 bits cannot overflow within a region


def _words(col: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashed(df: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    return df.select(*keep, _words(F.col(text_col)).alias("words")).select("*", window_hashes("words", SHINGLE).alias("h")).drop("words")


def _lanes(h: str) -> list[Column]:
    """The 64 bits of a hash as 22 longs of three counters."""
    out = []
    for k in range(-(-BITS // LANES)):
        bits = [f"shiftleft(shiftright({h}, {LANES * k + j}) & 1L, {LANE * j})" for j in range(LANES) if LANES * k + j < BITS]
        out.append(F.expr(" + ".join(bits)).alias(f"s{k}"))
    return out


def _fingerprint(sums: list[str], size: str) -> Column:
    """Bit b is set where more than half of the window's shingles have it."""
    terms = [
        f"if(2 * (shiftright({sums[b // LANES]}, {LANE * (b % LANES)}) & {(1 << LANE) - 1}L) > {size}, shiftleft(1L, {b}), 0L)"
        for b in range(BITS)
    ]
    return F.expr(" | ".join(terms))


def _block_values(fp: str) -> Column:
    parts, at = [], 0
    for i, width in enumerate(BLOCKS):
        parts.append(f"struct({i} AS block, cast(shiftright({fp}, {at}) & {(1 << width) - 1}L AS int) AS value)")
        at += width
    return F.expr(f"array({', '.join(parts)})")


def _near_values() -> Column:
    """All values within ``FLIPS`` bits of ``value`` in ``block``."""
    def masks(width):
        return [sum(1 << i for i in c) for n in range(FLIPS + 1) for c in combinations(range(width), n)]

    arms = " ".join(f"WHEN {w} THEN array({', '.join(map(str, masks(w)))})" for w in sorted(set(BLOCKS)))
    widths = f"element_at(array({', '.join(map(str, BLOCKS))}), block + 1)"
    return F.expr(f"transform(CASE {widths} {arms} END, m -> m ^ value)")


def _size_class(s: Column) -> Column:
    return F.floor(F.log(s.cast("double")) / F.lit(math.log(GROWTH)) + F.lit(1e-9)).cast("int")


def _class_length(c: int) -> int:
    return max(1, round(GROWTH ** (c + 0.5)))


def _bitmap(items: DataFrame, bits: int) -> Column:
    """The items' shingles as a literal array of ``bits / 64`` longs; two probes per shingle."""
    at = items.select(F.explode("h").alias("x")).select(F.explode(F.array(*_probes(F.col("x"), bits))).alias("b"))
    rows = at.groupBy(F.expr("cast(b div 64 AS int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 AS int)))").alias("v")).collect()
    words = ["0"] * (bits // 64)
    for r in rows:  # at most bits / 64 rows
        words[r["w"]] = str(r["v"])
    return F.split(F.lit(",".join(words)), ",").cast("array<bigint>")


def _probes(x: Column, bits: int) -> list[Column]:
    return [F.shiftright(x, by).bitwiseAND(F.lit(bits - 1)) for by in (3, 33)]


def _in_bitmap(held: Column, x: Column, bits: int) -> Column:
    one, two = [F.getbit(F.get(held, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in _probes(x, bits)]
    return one & two


def _numbered(arr: str) -> Column:
    """A multiset as a set: each element of a sorted array with its number among its equals."""
    return F.transform(arr, lambda x, k: F.struct(x.alias("x"), (k - F.array_position(arr, x)).alias("k")))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, percent: int = 75, bitmap_bits: int = BITMAP_BITS,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``(doc_id, item_id, start, similarity)``: the best window of each item in each document."""
    hashed = _hashed(benchmark, item_text, F.col(item_id).cast("long").alias("item_id"))
    hashed = hashed.select("item_id", "h", F.size("h").alias("s"), F.monotonically_increasing_id().alias("item")).filter("s > 0")
    items = materialize(hashed.withColumn("class", _size_class(F.col("s"))), "items")
    sizes = items.groupBy("class").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).orderBy("class").collect()  # some 100 rows at most
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start long, similarity double")
    need = lambda s: -(-percent * s // 100)
    least, most = sizes[0]["lo"], sizes[-1]["hi"]

    # 1. Positions that may belong to an item.  The id generator also keeps the filter above the hashing.
    held = _bitmap(items, bitmap_bits)
    hits = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: _in_bitmap(held, F.get("h", i), bitmap_bits))
    found = _hashed(docs, text_col, F.col(id_col).cast("long").alias("doc_id")).select(
        F.monotonically_increasing_id().alias("key"), "doc_id", "h", F.when(F.size("h") > 0, hits).alias("hits")
    )
    found = materialize(found.filter(F.size("hits") >= need(least)), "hits")

    # 2. Regions: hits closer than the longest item, cut every SPAN positions.
    by_pos = Window.partitionBy("key").orderBy("pos")
    rows = found.select("key", F.explode("hits").alias("pos"))
    rows = rows.withColumn("new", F.coalesce((F.col("pos") - F.lag("pos").over(by_pos) > most).cast("int"), F.lit(0)))
    rows = rows.withColumn("region", F.sum("new").over(by_pos)).withColumn("span", F.expr(f"pos div {SPAN}"))
    grouped = rows.groupBy("key", "region", "span").agg(F.sort_array(F.collect_list("pos")).alias("at")).filter(
        (F.size("at") >= need(least)) | (F.element_at("at", -1) + most >= (F.col("span") + 1) * SPAN)
    )
    low, high = F.element_at("at", 1), F.element_at("at", -1)
    regions = grouped.join(found.select("key", "doc_id", "h"), "key").select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", low.alias("low"),
        F.transform("at", lambda p: p - F.element_at("at", 1)).alias("at"),
        F.slice("h", low + 1, high - low + most).alias("part"),
        (high + most >= (F.col("span") + 1) * SPAN).alias("cut"),
    )
    regions = materialize(regions, "regions")

    # Running sums of the fingerprint counters along each region.
    sums = [f"s{k}" for k in range(-(-BITS // LANES))]
    lanes = regions.select("rid", F.posexplode("part").alias("pos", "x")).select("rid", "pos", *_lanes("x"))
    run = Window.partitionBy("rid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = lanes.select("rid", "pos", *[F.sum(k).over(run).alias(k) for k in sums])
    prefix = running.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", *sums))).alias("p"))

    # Windows that hold enough hits, for each size class.
    kinds = F.array(*[
        F.struct(F.lit(r["class"]).alias("class"), F.lit(max(r["lo"], min(r["hi"], _class_length(r["class"])))).alias("size"),
                 F.lit(need(r["lo"])).alias("need"), F.lit(r["hi"]).alias("reach"))
        for r in sizes
    ])
    starts = F.transform("at", lambda a, i: F.transform(
        F.filter(kinds, lambda k: F.coalesce(F.get("at", i + k["need"] - 1) < a + k["reach"], F.col("cut"))),
        lambda k: F.struct(a.alias("a"), k["class"].alias("class"), F.least(k["size"], F.size("part") - a).alias("n")),
    ))
    windows = regions.select("rid", F.flatten(starts).alias("w")).join(prefix, "rid")
    windows = windows.select("rid", F.explode(F.transform("w", lambda w: F.struct(
        w["a"].alias("a"), w["class"].alias("class"), w["n"].alias("n"),
        F.get("p", w["a"] + w["n"] - 1).alias("e"), F.get("p", w["a"] - 1).alias("b"),
    ))).alias("w"))
    windows = windows.select("rid", "w.a", "w.class", "w.n", *[(F.col(f"w.e.{k}") - F.coalesce(F.col(f"w.b.{k}"), F.lit(0))).alias(k) for k in sums])
    windows = windows.select("rid", "a", "class", _fingerprint(sums, "n").alias("fp"))

    # 3. Items within the radius, by blocks.
    counted = items.select("item", "class", "s", F.explode("h").alias("x")).select("item", "class", "s", *_lanes("x"))
    counted = counted.groupBy("item", "class", "s").agg(*[F.sum(k).alias(k) for k in sums])
    index = counted.select("item", "class", _fingerprint(sums, "s").alias("item_fp")).select("*", F.explode(_block_values("item_fp")).alias("b"))
    index = index.select("item", "class", "item_fp", "b.block", "b.value").select("item", "class", "item_fp", "block", F.explode(_near_values()).alias("value"))
    probes = windows.select("*", F.explode(_block_values("fp")).alias("b")).select("rid", "a", "class", "fp", "b.block", "b.value")
    near = probes.join(index, ["class", "block", "value"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    near = near.select("rid", "a", "item").distinct()

    # 4. Exact weighted similarity at the item's own size.
    pairs = near.join(regions.select("rid", "doc_id", "low", "part"), "rid").join(items.select("item", "item_id", "h", "s"), "item")
    pairs = pairs.select("doc_id", "item_id", (F.col("low") + F.col("a")).cast("long").alias("start"),
                         F.array_sort(F.slice("part", F.col("a") + 1, F.col("s"))).alias("x"), F.array_sort("h").alias("y"))
    shared = pairs.select("doc_id", "item_id", "start", F.size(F.array_intersect(_numbered("x"), _numbered("y"))).alias("i"), (F.size("x") + F.size("y")).alias("n"))
    close = shared.filter(100 * F.col("i") >= percent * (F.col("n") - F.col("i")))
    best = close.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("i") / (F.col("n") - F.col("i"))).alias("similarity"), (-F.col("start")).alias("m"))).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.m")).alias("start"), "b.similarity")
