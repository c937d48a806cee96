"""Language-model scores from Elias-Fano n-gram tries.

Counts.  Words of the training texts are counted per task before they are shuffled;
unigram counts cover every word.  The counts of the ``head`` commonest words (of fixed
size) are at hand in every task, all other words meet their exact counts in a join.
All words of the training texts form pairs and triples.  A head word goes by its rank,
any other by a 63-bit hash, so no table of words is needed to name them; a bitmap of
fixed size drops most words seen less than ``least`` times, which are in no kept pair
(no word seen as often is dropped).  A number given as ``vocabulary`` restricts pairs
and triples to that many of the head words.

Model.  P(w | v) = q(v, w) + rest(v) * P(w), with P the add-one unigram
distribution, q the pair counts under absolute discounting, divided by the count of
v, for pairs seen at least ``least`` times, quantised downwards to ten levels an octave, and
rest(v) what the quantised q leave over, so that probabilities sum to one exactly.
With an ``order`` of 3 likewise P(w | u, v) = q(u, v, w) + rest(u, v) * P(w | v) from the
triples seen at least ``least`` times and the count of u, v.  A word in no pair gives no
context: P(w | v) = P(w).  The first word of a text follows a start mark alone, the second
the start mark and the first.

Tries.  One pass over the texts packs the words of each chunk of texts, with the one or two
before, by shards of their context v, and what the head words give.  A shard holds every
occurrence of its contexts, of training texts and others: its task counts them, builds the
trie (see :class:`Trie3`) and looks the n-grams of all texts up in it.  Texts go by their number
in the chunk there and back, and what a shard adds to the texts of a chunk is one row.
Contexts seen more than ``SPREAD`` times are spread over shards by the word before them; their pairs
are counted first, packed by as many buckets, and given, packed, to each of these shards.  The number of shards follows the
texts, so the work of a task does not grow with the corpus.  Where w is outside the head,
P(w) meets what the trie gives in the join by words.  A word that the bitmap of words leaves
out and a training text holds occurs once (for a ``least`` of 2).

Defined cases: NULL and empty texts are the end token alone; without training texts
all counts are zero and every score is zero; rows that repeat an id and text get
equal scores; rows with a NULL id are scored (and learned from).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.elias_fano import Trie3
from weekpanel.llm.text import as_bytes, byte_words, lean, mix, release, signed, small_batches
from weekpanel.session import materialize

HEAD, VOCABULARY = 1 << 18, None  # commonest words at hand; all words form pairs
ORDER = 3
DISCOUNT, LEAST, STEPS = 0.75, 2, 10  # ten levels an octave
END = b" "  # never a word
WORDS_A_SHARD, SPREAD, AT_ONCE = 3_000_000, 500_000, 150_000
CHUNK, BUFFER, WORDS = 1_200_000, 3_000_000, 500_000  # bytes; pairs; words
TEXTS = 30_000  # in a chunk, so that their numbers are short
SEED, SEEN_BITS = 42, 1 << 24  # the seed of Spark's xxhash64
NONE = 1 << 62  # the id of a word in no pair


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words, summed within the task while ``WORDS`` are distinct."""
    counts: Counter[bytes] = Counter()

    def emit():
        words, n = list(counts), list(counts.values())
        for i in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 50_000], pa.binary()), pa.array(n[i : i + 50_000], pa.int64())], ["word", "n"])
        counts.clear()

    for batch in batches:
        for text in as_bytes(batch.column(0)):
            counts.update(_tokens(text or b""))
            if len(counts) > WORDS:
                yield from emit()
    yield from emit()


def _summed_pairs(context: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((word, context))
    context, word = context[order], word[order]
    new = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])]))
    return context[new], word[new], np.add.reduceat(n[order], new)


def _count_spread(shared, shards: int):
    """Partial counts of the pairs whose context is spread over shards, summed within the task as far as memory allows
    and packed by bucket: the shard that a text's first word would go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        words = WordIds(m.head, m.start, m.seen)
        pack = zstandard.ZstdCompressor(level=1)
        held, other, waiting = [], [], 0

        def emit():
            parts = []
            if held:
                code, n = _summed(*zip(*held, strict=True))
                parts.append((*_split(code, m.start), n))
            if other:
                parts.append(_summed_pairs(*(np.concatenate(x) for x in zip(*other, strict=True))))
            held.clear()
            other.clear()
            if not parts:
                return
            context, word, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            bucket = _shard(context, word, np.full(len(context), NONE), shards, m.shards)
            order = np.argsort(bucket, kind="stable")
            used, first = np.unique(bucket[order], return_index=True)
            blobs = [pack.compress(b"".join(_planes(x[at]) for x in (context, word, n))) for at in np.split(order, first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for batch in batches:
            tokens, sizes = _joined([text or b"" for text in as_bytes(batch.column(0))])
            if not tokens:
                continue
            numbers = words.numbers(tokens)
            context, _ = _before(words.ids(tokens, numbers, np.zeros(0, np.int64)), sizes, m.start)
            at = np.flatnonzero(context != NONE)
            at = at[m.shards[context[at]] > 1]
            context, word = context[at], words.ids(tokens, numbers, at[numbers[at] < 0])[at]
            head = (word >= 0) & (word != NONE)
            code, n = np.unique((context[head] << m.start.bit_length()) | word[head], return_counts=True)
            held.append((code, n))
            if (word < 0).any():
                other.append(_summed_pairs(context[word < 0], word[word < 0], np.ones(int((word < 0).sum()), np.int64)))
                waiting += 2 * len(other[-1][0])
            waiting += len(code)
            if waiting > BUFFER:
                yield from emit()
                waiting = 0
        yield from emit()

    return run


class WordIds:
    """Numbers and ids of words.  A number is a rank in the head, -1 for others.  The id in pairs is the rank of
    one of the first ``start`` head words, below zero the hash of a word outside the head that ``seen`` may
    hold, else ``NONE``; without ``seen`` only head words form pairs.  ``start`` is also the start mark."""

    def __init__(self, head: list[bytes], start: int, seen: np.ndarray | None):
        self.ranks, self.start, self.seen = {w: i for i, w in enumerate(head)}, start, seen

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ranks.get, words, repeat(-1)), np.int64, len(words))

    def ids(self, words: list[bytes], numbers: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Ids; of the words outside the head those at the places ``other``, ``NONE`` for the rest."""
        ids = np.where((numbers >= 0) & (numbers < self.start), numbers, NONE)
        if self.seen is not None and len(other):
            h = np.fromiter((xxhash.xxh64_intdigest(words[i], SEED) for i in other.tolist()), np.uint64, len(other)) | np.uint64(1 << 63)
            held = np.ones(len(h), bool)
            for by in (3, 33):
                at = (h >> np.uint64(by)) & np.uint64(SEEN_BITS - 1)
                held &= (self.seen[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            ids[other[held]] = h[held].view(np.int64)
        return ids


def _hash_id(word: str) -> Column:
    return F.xxhash64(word).bitwiseOR(F.lit(-(1 << 63)))


def _seen(ids: DataFrame) -> np.ndarray:
    """The bitmap of the column ``id``, two probes an id (at most SEEN_BITS / 64 rows reach the driver)."""
    at = ids.select(F.explode(F.array(*[F.shiftright("id", by).bitwiseAND(F.lit(SEEN_BITS - 1)) for by in (3, 33)])).alias("b"))
    rows = at.groupBy(F.expr("cast(b div 64 AS int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 AS int)))").alias("v")).toArrow()
    out = np.zeros(SEEN_BITS // 64, np.int64)
    out[rows["w"].to_numpy()] = rows["v"].to_numpy()
    return out.view(np.uint64)


def _tokens(text: bytes) -> list[bytes]:
    return [*byte_words(text), END]


def _joined(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The tokens of several texts and how many each has."""
    tokens: list[bytes] = []
    sizes = []
    for text in texts:
        own = _tokens(text)
        tokens += own
        sizes.append(len(own))
    return tokens, np.array(sizes, np.int64)


def _before(ids: np.ndarray, sizes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids one and two places before each; a text's first word follows ``start``, its second ``start`` and the first."""
    first = np.cumsum(sizes) - sizes
    one, two = np.empty_like(ids), np.full_like(ids, NONE)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    one[first], two[first] = start, NONE
    two[first[sizes > 1] + 1] = start
    return one, two


def _split(code: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and word of a pair of head words."""
    width = start.bit_length()
    return code >> width, code & ((1 << width) - 1)


def _shard(v: np.ndarray, w: np.ndarray, u: np.ndarray, shards: int, spread: np.ndarray) -> np.ndarray:
    """Shard of a word ``w`` after ``u`` and ``v``: one a context ``v``, or one of the ``spread`` next to it, by ``u`` (by ``w`` where there is no ``u``)."""
    out = mix(v.view(np.uint64)) % np.uint64(shards)
    many = np.flatnonzero((v >= 0) & (v < len(spread)))
    many = many[spread[v[many]] > 1]
    by = np.where(u[many] == NONE, w[many], u[many]).view(np.uint64)
    out[many] = (out[many] + mix(by) % spread[v[many]].view(np.uint64)) % np.uint64(shards)
    return out.astype(np.int64)


def _part(v: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(v.view(np.uint64)) >> np.uint64(40)) % np.uint64(parts)).astype(np.uint16)


def _level(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.ceil(-np.log2((n - DISCOUNT) / total) * STEPS).astype(np.int64)


def _q(level: np.ndarray) -> np.ndarray:
    return np.exp2(level / -STEPS)


def _key(doc, learned: bool, text: bytes) -> int:
    """A row's key, from all 64 bits of its id (or that it has none), whether it is learned from, and its text:
    rows equal in these share it."""
    mark = (b"+" if learned else b"-") + (b"" if doc is None else doc.to_bytes(8, "little", signed=True))
    return xxhash.xxh3_64_intdigest(len(mark).to_bytes(1, "little") + mark + text)


def _chunk(keys: list[int]) -> int:
    """A chunk's key, from those of its rows: chunks of equal rows share it."""
    return xxhash.xxh3_64_intdigest(np.array(keys, np.uint64).tobytes())


class Model:
    """What every task needs, of fixed size: head words by falling count, the bitmap of other words, whether that
    bitmap holds every word that is not single, over how many shards each context of the head is spread and, for
    those over several, their rests."""

    def __init__(self, head: list[bytes], counts: np.ndarray, total: int, distinct: int, start: int, seen: np.ndarray | None, least: int, order: int, shards: np.ndarray):
        self.head, self.start, self.seen, self.least, self.order, self.shards = head, start, seen, least, order, shards
        self.singles, self.rest = least == 2 and seen is not None, np.ones(start + 1)
        self.unigram, self.once = (np.log10((c + 1) / (total + distinct + 1)) for c in (counts, 1))


# A text is a chunk and a number in it.  ``n`` is 0 in the row of a text, NULL in the rows of what its pairs and triples
# add: ``more`` for each of ``numbers``, or the logarithm of 1 + ``ratio`` / P with the probability P of the word
PARTS = "chunk long, number smallint, word binary, n long, doc_id long, n_tokens long, n_head long, head_base double, ratio double, numbers array<smallint>, more array<double>"
_KINDS = {
    "long": pa.int64(), "smallint": pa.int16(), "binary": pa.binary(), "double": pa.float64(), "array<smallint>": pa.list_(pa.int16()), "array<double>": pa.list_(pa.float64()),
}
PART_SCHEMA = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in PARTS.split(", "))])
PACKED = "shard int, kind int, blob binary, chunk long"
PACKED_KINDS = [pa.int32(), pa.int32(), pa.binary(), pa.int64()]


def _part_batch(**columns) -> pa.RecordBatch:
    size = len(columns["chunk"])
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in PART_SCHEMA]
    return pa.RecordBatch.from_arrays(arrays, schema=PART_SCHEMA)


def _marked(mark: bytes, raw: np.ndarray) -> pa.Array:
    """No words, since they begin with a blank: rows of bytes by which rows are dealt in the join by words."""
    n, size = len(raw), 1 + len(mark) + raw.shape[1]
    whole = np.empty((n, size), np.uint8)
    whole[:, : 1 + len(mark)] = np.frombuffer(END + mark, np.uint8)
    whole[:, 1 + len(mark) :] = raw
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * size), pa.py_buffer(whole)])


def _blanks(key: np.ndarray) -> pa.Array:
    """For rows that need no word."""
    return _marked(b"k", np.ascontiguousarray(key).view(np.uint8).reshape(-1, 8)[:, :3])


def _other(ids: np.ndarray) -> pa.Array:
    """For words outside the head, by their ids."""
    return _marked(b"w", ids.astype(">i8").view(np.uint8).reshape(-1, 8))


def _planes(numbers: np.ndarray) -> bytes:
    """Bytes by place: the high ones of small numbers are runs of zeros."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T).tobytes()


def _unplaned(raw: bytes, kind, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()


def _packed(columns: list[np.ndarray], new: np.ndarray, learned: np.ndarray, number: np.ndarray, start: int) -> bytes:
    """Ids by column (the few of words outside the head apart), where a new text begins, which texts are learned from and their rising numbers."""
    parts = [np.array([len(new), len(columns)], np.int64).tobytes()]
    for ids in columns:
        other = ids < 0
        parts.append(_planes(np.where(other, start + 2, np.where(ids == NONE, start + 1, ids)).astype(np.uint32)))
        parts.append(ids[other].tobytes())
    steps = np.diff(number, prepend=0).astype(np.uint16)
    return b"".join([*parts, new.astype(np.uint8).tobytes(), learned.astype(np.uint8).tobytes(), _planes(steps)])


def _unpacked(raw: bytes, start: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Columns of ids, which of the texts here each is of, which texts are learned from, their numbers in the chunk."""
    n, k = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    columns, at = [], 16
    for _ in range(k):
        ids = _unplaned(raw, np.uint32, n, at).astype(np.int64)
        other = np.flatnonzero(ids == start + 2)
        ids[ids == start + 1] = NONE
        ids[other] = np.frombuffer(raw, np.int64, len(other), at + 4 * n)
        columns.append(ids)
        at += 4 * n + 8 * len(other)
    text = np.cumsum(np.frombuffer(raw, np.uint8, n, at), dtype=np.int32) - 1
    at, texts = at + n, int(text[-1]) + 1
    learned = np.frombuffer(raw, np.uint8, texts, at) > 0
    return columns, text, learned, np.cumsum(_unplaned(raw, np.uint16, texts, at + texts)).astype(np.int16)


def _asked(shared, shards: int):
    """The one pass over the texts.  Per chunk of texts: rows of kind 1, a shard's words with those before and the numbers of their
    texts, and one row of kind 2, what the head words give per text (``n`` is 0) and the other words of each text with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        words, pack = WordIds(m.head, m.start, m.seen), zstandard.ZstdCompressor(level=1)
        held: list[tuple] = []
        turn = waiting = 0

        def packed(chunk: int, learned: np.ndarray, text: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple]:
            """Rows of kind 1."""
            v, w = columns[:2]
            u = columns[2] if m.order == 3 else np.full(len(v), NONE)
            shard = _shard(v, w, u, shards, m.shards).astype(np.uint16 if shards < 1 << 16 else np.int64)
            order = np.argsort(shard, kind="stable")  # words of a text stay together
            edges = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.int64))
            for s in range(shards):
                at = order[edges[s] : edges[s + 1]]
                if len(at):
                    new = np.diff(text[at], prepend=-1) > 0
                    used = text[at[new]]
                    yield s, 1, pack.compress(_packed([c[at] for c in columns], new, learned[used], used, m.start)), chunk

        def emit():
            nonlocal turn
            doc, learned, texts = zip(*held, strict=True)
            chunk, flags = int(signed([_chunk([_key(*h) for h in held])])[0]), np.array(learned, bool)
            tokens, sizes = _joined(texts)
            numbers = words.numbers(tokens)
            other = np.flatnonzero(numbers < 0)
            ids = words.ids(tokens, numbers, other)
            text = np.repeat(np.arange(len(texts)), sizes)
            head = numbers >= 0
            n_head = np.bincount(text[head], minlength=len(texts))
            head_base = np.bincount(text[head], m.unigram[numbers[head]], len(texts))
            if m.singles:
                single = (ids[other] == NONE) & flags[text[other]]
                once = np.bincount(text[other[single]], minlength=len(texts))
                n_head, head_base, other = n_head + once, head_base + once * m.once, other[~single]
            rare = Counter(zip(text[other].tolist(), [tokens[i] for i in other.tolist()], strict=True))
            context, before = _before(ids, sizes, m.start)
            at = np.flatnonzero(context != NONE)
            rows = list(packed(chunk, flags, text[at], [x[at] for x in (context, ids, before)[: m.order]]))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, PART_SCHEMA) as stream:
                of, blank, number = np.full(len(texts), chunk), np.zeros(len(texts), np.int64), np.arange(len(texts), dtype=np.int16)
                stream.write_batch(_part_batch(chunk=of, number=number, word=_blanks(of), n=blank, doc_id=doc, n_tokens=sizes, n_head=n_head, head_base=head_base))
                stream.write_batch(_part_batch(chunk=np.full(len(rare), chunk), number=np.array([t for t, _ in rare], np.int16), word=[w for _, w in rare], n=list(rare.values())))
            rows.append((turn % shards, 2, pack.compress(sink.getvalue()), chunk))
            turn += 1
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), PACKED_KINDS, strict=True)], [c.split()[0] for c in PACKED.split(", ")])

        for batch in batches:
            docs, flags = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for doc, text, learned in zip(docs, as_bytes(batch.column(1)), flags, strict=True):
                held.append((doc, learned, text or b""))
                waiting += len(held[-1][2])
                if waiting > CHUNK or len(held) == TEXTS:
                    yield from emit()
                    waiting = 0
        if held:
            yield from emit()

    return run


def _pack_pairs(spread: np.ndarray, total: np.ndarray, least: int):
    """The kept pairs of the contexts that are spread (seen ``total`` times), per bucket and context: packed, and the sum of their q."""

    def run(_: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        given = []
        for blob in group.column("blob"):
            raw = unpack.decompress(blob.as_py())
            n = len(raw) // 24
            given.append([_unplaned(raw, np.int64, n, 8 * i * n) for i in range(3)])
        context, word, n = _summed_pairs(*(np.concatenate(x) for x in zip(*given, strict=True)))
        context, word, n = (x[n >= least] for x in (context, word, n))
        level = _level(n, total[np.searchsorted(spread, context)])
        names, first = np.unique(context, return_index=True)
        blobs, q = [], []
        for name, i, j in zip(names, first, [*first[1:], len(context)], strict=True):
            blobs.append(pack.compress(b"".join([name.tobytes(), _planes(word[i:j]), _planes(level[i:j])])))
            q.append(_q(level[i:j]).sum())
        release()
        return pa.table({"context": pa.array(names, pa.int64()), "blob": pa.array(blobs, pa.binary()), "q": pa.array(q, pa.float64())})

    return run


def _dense(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_inverse=True)


def _found(held: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``asked`` among the rising ``held``, and whether each is there."""
    at = np.minimum(np.searchsorted(held, asked), len(held) - 1)
    return at, held[at] == asked


def _score_shard(shared):
    """Counts a shard's n-grams, builds its trie and looks the n-grams of all its texts up in it."""

    def run(_: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        m: Model = shared.value
        unpack = zstandard.ZstdDecompressor()
        out, chunks, numbers, learned, columns, texts, spread = [], [], [], [], [], [], []
        seen = 0
        for batch in group.to_batches():
            kind, blob, own = (batch.column(batch.schema.get_field_index(c)) for c in ("kind", "blob", "chunk"))
            for i in range(batch.num_rows):
                raw = unpack.decompress(blob[i].as_py())
                if kind[i].as_py() == 0:
                    n = (len(raw) - 8) // 16
                    spread.append((np.full(n, np.frombuffer(raw, np.int64, 1)[0]), _unplaned(raw, np.int64, n, 8), _unplaned(raw, np.int64, n, 8 + 8 * n)))
                elif kind[i].as_py() == 1:
                    ids, text, flags, number = _unpacked(raw, m.start)
                    columns.append(ids)
                    texts.append(text + np.int32(seen))
                    learned.append(flags)
                    chunks.append(own[i].as_py())
                    numbers.append(number)
                    seen += len(flags)
                else:
                    out += pa.ipc.open_stream(raw)
        if columns:
            v, w, *u = (np.concatenate([c.pop(0) for c in columns]) for _ in range(m.order))  # one column at a time
            given = tuple(np.concatenate(c) for c in zip(*spread, strict=True)) if spread else (np.zeros(0, np.int64),) * 3
            spread.clear()
            text, flags, number = np.concatenate(texts), np.concatenate(learned), np.concatenate(numbers)
            texts.clear()
            chunks, sizes = np.array(chunks, np.int64), [len(x) for x in numbers]
            chunk = np.repeat(chunks, sizes)
            more = np.zeros(len(number))
            parts = len(v) // AT_ONCE + 1  # a context's words are in one part
            part, given_part = _part(v, parts), _part(given[0], parts)
            for p in range(parts):
                at = np.flatnonzero(part == p)
                if not len(at):
                    continue
                before = u[0][at] if u else np.full(len(at), NONE)
                value, ratio, tail, back = _values(m, v[at], w[at], before, flags[text[at]], tuple(g[given_part == p] for g in given))
                more += np.bincount(text[at], value[back], len(number))
                late = np.flatnonzero(tail[back] < 0)
                at, back = at[late], back[late]
                out.append(_part_batch(chunk=chunk[text[at]], number=number[text[at]], word=_other(tail[back]), ratio=ratio[back]))
            edges = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = {"numbers": pa.ListArray.from_arrays(edges, pa.array(number)), "more": pa.ListArray.from_arrays(edges, pa.array(more))}
            out.append(_part_batch(chunk=chunks, word=_blanks(chunks), **lists))
        release()
        return pa.Table.from_batches(out, PART_SCHEMA)

    return run


def _values(m: Model, v: np.ndarray, w: np.ndarray, u: np.ndarray, learned: np.ndarray, given: tuple[np.ndarray, ...]):
    """What each distinct (u, v, w) adds to the logarithm of P(w), log10(a / P(w) + b): all of it, or for words outside the
    head log10(b), with the ratio a / b and the word's id (else 0); and which of them each occurrence is."""
    (vs, vi), (ws, wi), (us, ui) = map(_dense, (v, w, u))
    pairs, pi = _dense(vi * len(ws) + wi)
    contexts, ci = _dense(vi * len(us) + ui)
    triples, ti = _dense(pi * len(us) + ui)
    pair_v, pair_w = np.divmod(pairs, len(ws))
    context_v, context_u = np.divmod(contexts, len(us))
    triple_p, triple_u = np.divmod(triples, len(us))
    triple_v = pair_v[triple_p]
    triple_c = np.searchsorted(contexts, triple_v * len(us) + triple_u)
    count = lambda at, size: np.bincount(at[learned], minlength=size)

    # pairs: counted here, or given for contexts that are spread
    single = (vs < 0) | (vs > m.start)
    single[~single] = m.shards[vs[~single]] == 1
    n = count(pi, len(pairs))
    kept = (n >= m.least) & (ws[pair_w] != NONE) & single[pair_v]
    level = np.zeros(len(pairs), np.int64)
    level[kept] = _level(n[kept], count(vi, len(vs))[pair_v[kept]])
    rest = 1 - np.bincount(pair_v[kept], _q(level[kept]), len(vs))
    rest[~single] = m.rest[vs[~single]]
    (at, known), (word, known_word) = _found(vs, given[0]), _found(ws, given[1])
    known &= known_word
    at, here = _found(pairs, (at * len(ws) + word)[known])
    kept[at[here]], level[at[here]] = True, given[2][known][here]

    # triples: a kept one is made of kept pairs
    n = count(ti, len(triples))
    kept3 = (n >= m.least) & (us[triple_u] != NONE) & kept[triple_p]
    level3 = _level(n[kept3], count(ci, len(contexts))[triple_c[kept3]])
    rest3 = 1 - np.bincount(triple_c[kept3], _q(level3), len(contexts))
    held = np.zeros(len(contexts), bool)
    held[triple_c[kept3]] = True
    number, number3 = np.cumsum(kept) - 1, np.cumsum(held) - 1
    trie = Trie3(
        len(vs), (pair_v[kept], pair_w[kept], level[kept]), (context_u[held], context_v[held], rest3[held]),
        (number[triple_p[kept3]], number3[triple_c[kept3]], level3),
    )

    # every n-gram of the texts is looked up
    pair, context = trie.pairs.at(pair_v, pair_w), trie.context(context_u, context_v)
    q = np.where(pair >= 0, _q(trie.pairs.level[pair]), 0.0) if kept.any() else np.zeros(len(pairs))
    r = np.where(context >= 0, trie.value[context], 1.0) if held.any() else np.ones(len(contexts))
    level3 = trie.triple(pair[triple_p], context[triple_c], triple_v)
    a = np.where(level3 >= 0, _q(level3), 0.0) + r[triple_c] * q[triple_p]
    b = r[triple_c] * rest[triple_v]
    word = ws[pair_w[triple_p]]
    tail = np.where((a > 0) & (word < 0), word, 0)
    value = np.zeros(len(triples))
    some = np.flatnonzero((a > 0) & (word >= 0))
    value[some] = a[some] / 10.0 ** m.unigram[word[some]]
    return np.log10(value + b), a / b, tail, ti


def head_words(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray, DataFrame]:
    """The commonest words by falling count, at most ``most``, and their counts: all
    words above a count, found from a histogram of the counts' logarithms (at most a
    few hundred rows); and the rows of the other words."""
    bin_ = F.floor(F.log2("n") * 16).cast("int")
    total, cut = 0, None
    for r in counts.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("w")).orderBy(F.desc("b")).collect():
        if total + r["w"] > most:
            break
        total, cut = total + r["w"], r["b"]
    if cut is None:
        return [], np.zeros(0, np.int64), counts
    got = sorted((-n, w) for w, n in counts.filter(bin_ >= cut).toArrow().to_pandas().itertuples(index=False, name=None))
    return [w for _, w in got], np.array([-n for n, _ in got], np.int64), counts.filter(bin_ < cut)


def lm_scores(
    docs: DataFrame, train: Column, head: int = HEAD, vocabulary: int | None = VOCABULARY, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", order: int = 2,
) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``;
    ``train`` marks the rows to learn from, ``order`` (2 or 3) is the length of the longest n-grams."""
    if order not in (2, 3):
        raise ValueError("the order is 2 or 3")
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("learned"))
    learn = docs.filter(train).select(F.col(text_col).alias("text"))

    counts = learn.mapInArrow(lean(_count_words), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    words, n_words, tail = head_words(counts, head)
    start = len(words) if vocabulary is None else min(vocabulary, len(words))  # the start mark is the last context
    texts = int(n_words[words.index(END)]) if END in words else learn.count()  # the end token occurs once a text
    sc = spark.sparkContext
    # Words outside the head that may be in a kept pair; two of one hash (none in practice) count as one.
    others = tail.filter(F.col("n") >= least).groupBy(_hash_id("word").alias("id")).agg(F.sum("n").alias("id_n"))
    wide = vocabulary is None and not tail.filter(F.col("n") >= least).isEmpty()
    others = materialize(others, "other-words") if wide else None
    seen = _seen(others) if wide else None
    release()

    size = F.octet_length("text") + 1
    every, learned = read.agg(F.sum(F.coalesce(size, F.lit(1))), F.sum(F.when(F.col("learned"), F.coalesce(size, F.lit(1))))).first()
    shards = max(4, -(-int(total * (every or 0) / (learned or 1)) // WORDS_A_SHARD))
    n_contexts = np.append(n_words[:start], texts).astype(np.int64)
    model = Model(words, n_words, total, distinct, start, seen, least, order, np.clip(-(-n_contexts // SPREAD), 1, shards))
    known = sc.broadcast(model)
    spread = np.flatnonzero(model.shards > 1)
    asked = None
    if len(spread):
        pairs = learn.mapInArrow(lean(_count_spread(known, shards)), "bucket int, blob binary")
        pairs = pairs.groupBy("bucket").applyInArrow(_pack_pairs(spread, n_contexts[spread], least), "context long, blob binary, q double")
        pairs = materialize(pairs, "spread-pairs")
        for context, q in pairs.groupBy("context").agg(F.sum("q")).collect():
            model.rest[context] = 1 - q
        known.unpersist()
        known = sc.broadcast(model)
        first = (mix(spread.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
        to = [(int(c), int((f + i) % shards)) for c, f in zip(spread, first, strict=True) for i in range(model.shards[c])]
        to = spark.createDataFrame(pd.DataFrame(to, columns=["context", "shard"])).withColumn("shard", F.col("shard").cast("int"))
        asked = pairs.join(F.broadcast(to), "context").select("shard", F.lit(0).alias("kind"), "blob", F.lit(0).cast("long").alias("chunk"))
    spark._jvm.System.gc()  # the files of finished shuffles go with their plans
    packed = read.mapInArrow(lean(_asked(known, shards)), PACKED)
    asked = packed if asked is None else asked.union(packed)

    # Words outside the head by themselves, for their probabilities, and by their ids, for what the tries give.
    tail = tail.select("word", F.col("n").alias("c"))
    if wide:
        tail = tail.union(others.select(F.concat(F.lit(" w").cast("binary"), F.unhex(F.hex("id"))), "id_n"))

    # texts of equal chunks share chunk and number: parts summed over them are divided by how many there are
    parts = asked.groupBy("shard").applyInArrow(_score_shard(known), PARTS).join(tail, "word", "left")
    p = (F.coalesce("c", F.lit(0)) + 1) / F.lit(float(total + distinct + 1))
    one = F.array(F.struct(F.col("number").alias("numbers"), F.lit(None).cast("double").alias("more")))
    parts = parts.select("chunk", "n", "doc_id", "n_tokens", "n_head", "head_base", "ratio", "c", F.inline(F.coalesce(F.arrays_zip("numbers", "more"), one)))
    whole = parts.groupBy("chunk", "numbers").agg(
        F.count_if(F.col("n") == 0).alias("rows"), F.sum(F.col("n") * F.log10(p)).alias("tail_base"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_tail"),
        F.sum(F.coalesce("more", F.log10(F.col("ratio") / p + 1))).alias("more"), *[F.max(c).alias(c) for c in ("doc_id", "n_tokens", "n_head", "head_base")],
    )
    part = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("rows")
    base = F.col("head_base") + part("tail_base")
    out = whole.select(
        "doc_id", "n_tokens", (F.col("n_head") + part("n_tail").cast("long")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (base + part("more")).alias("score"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("i"),
    )
    return out.drop("i")
