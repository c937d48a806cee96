"""Elias-Fano sequences in numpy and the levels of n-gram tries made of them.

A monotone sequence is stored as fixed-width low parts and a bit vector in which
element ``i`` with high part ``h`` sets bit ``h + i``.  Counts of ones before every
64-bit word are kept beside the vector, so that the k-th one or zero is found by a
binary search over the counts and one step inside a word.  All parts of a trie lie
in one byte string of 8-byte-aligned levels that is used through a memory map.
"""

from __future__ import annotations

import tempfile

import numpy as np

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(axis=1).astype(np.int64)
# position of the k-th one (k = 0..7) in each byte value
_SELECT = np.array([[*np.flatnonzero(b), *[8] * (8 - b.sum())] for b in _BITS], np.int64)


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    parts = word[:, None].view(np.uint8).reshape(len(word), 8)
    upto = np.cumsum(_ONES[parts], axis=1)
    byte = (upto <= k[:, None]).sum(axis=1)
    at = np.arange(len(word))
    before = np.where(byte > 0, upto[at, np.maximum(byte - 1, 0)], 0)
    return byte * 8 + _SELECT[parts[at, byte], k - before]


class Sequence:
    """A monotone sequence read from the levels ``low, words, ones``."""

    def __init__(self, n: int, top: int, shift: int, low: np.ndarray, words: np.ndarray, ones: np.ndarray):
        self.n, self.top, self.shift, self.low, self.words, self.ones = n, top, shift, low, words, ones
        self.zeros = None

    @staticmethod
    def levels(values: np.ndarray) -> tuple[tuple[int, int, int], list[np.ndarray]]:
        n = len(values)
        top = int(values[-1]) if n else 0
        shift = 0 if n == 0 or top // n < 16 else 8 if top // n < 4096 else 16
        low = (values & ((1 << shift) - 1)).astype(np.uint16 if shift == 16 else np.uint8)[: n if shift else 0]
        at = (values >> shift) + np.arange(n)
        words = np.zeros(((top >> shift) + n) // 64 + 1, np.uint64)
        np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.uint32)
        return (n, top, shift), [low, words, ones]

    def _one(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th one."""
        w = np.searchsorted(self.ones, k, side="right") - 1
        return w * 64 + _select_in_word(np.ascontiguousarray(self.words[w]), k - self.ones[w].astype(np.int64))

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero."""
        if self.zeros is None:
            self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        w = np.searchsorted(self.zeros, k, side="right") - 1
        return w * 64 + _select_in_word(~np.ascontiguousarray(self.words[w]), k - self.zeros[w])

    def get(self, i: np.ndarray) -> np.ndarray:
        high = (self._one(i) - i) << self.shift
        return high | self.low[i].astype(np.int64) if self.shift else high

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first element >= x (n if there is none)."""
        out = np.full(len(x), self.n, np.int64)
        inside = np.flatnonzero(x <= self.top) if self.n else np.zeros(0, np.int64)
        h = x[inside] >> self.shift
        lo = np.zeros(len(h), np.int64)
        some = h > 0
        lo[some] = self._zero(h[some] - 1) - (h[some] - 1)
        # elements of the bucket end where the h-th zero stands; the last bucket ends with the sequence
        hi = np.full(len(h), self.n, np.int64)
        inner = h < self.top >> self.shift
        hi[inner] = self._zero(h[inner]) - h[inner]
        if self.shift:
            want = x[inside] & ((1 << self.shift) - 1)
            while (open_ := lo < hi).any():
                mid = (lo + hi) >> 1
                less = open_.copy()
                less[open_] = self.low[mid[open_]] < want[open_]
                lo = np.where(less, mid + 1, lo)
                hi = np.where(open_ & ~less, mid, hi)
        out[inside] = lo
        return out


def build_trie(context: np.ndarray, word: np.ndarray, level: np.ndarray, contexts: int) -> bytes:
    """Entries sorted by (context, word), contexts ``0 .. contexts-1``.

    Level one holds, per context, where its successors begin (monotone pointers).
    Level two holds the successors relative to their context: a word's value is the
    last value of the contexts before it, plus one, plus the word."""
    starts = np.searchsorted(context, np.arange(contexts + 1)).astype(np.int64)
    full = np.flatnonzero(np.diff(starts))
    last = np.cumsum(word[starts[full + 1] - 1].astype(np.int64) + 1)
    base = np.concatenate([[0], last[:-1]])
    values = word.astype(np.int64) + np.repeat(base, np.diff(starts)[full]) if len(full) else np.zeros(0, np.int64)
    head, parts = [], []
    for seq in (starts, values):
        numbers, levels = Sequence.levels(seq)
        head += numbers
        parts += levels
    parts.append(level.astype(np.uint16))
    head += [len(p) for p in parts]
    out = [np.array(head, np.int64).tobytes()]
    for p in parts:
        raw = p.tobytes()
        out.append(raw + b"\0" * (-len(raw) % 8))
    return b"".join(out)


class Trie:
    """A memory-mapped trie; its unlinked file goes when the trie is dropped."""

    def __init__(self, blob: bytes):
        self.file = tempfile.TemporaryFile()
        self.file.write(blob)
        self.file.flush()
        data = np.memmap(self.file, np.uint8, "r")
        head = data[: 13 * 8].view(np.int64)
        at, arrays = 13 * 8, []
        kinds = [self._low(head[2]), np.uint64, np.uint32, self._low(head[5]), np.uint64, np.uint32, np.uint16]
        for n, kind in zip(head[6:], kinds, strict=True):
            size = int(n) * np.dtype(kind).itemsize
            arrays.append(data[at : at + size].view(kind))
            at += size + -size % 8
        self.pointers = Sequence(*map(int, head[:3]), *arrays[:3])
        self.successors = Sequence(*map(int, head[3:6]), *arrays[3:6])
        self.level = arrays[6]

    @staticmethod
    def _low(shift) -> type:
        return np.uint16 if shift == 16 else np.uint8

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Probability level of each (context, word), -1 where there is no such entry."""
        out = self.at(context, word)
        out[out >= 0] = self.level[out[out >= 0]]
        return out

    def at(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place of each (context, word) among the entries, -1 where there is none."""
        out = np.full(len(context), -1, np.int64)
        if self.successors.n == 0 or not len(context):
            return out
        seen, back = np.unique(context, return_inverse=True)
        begin, end = self.pointers.get(seen), self.pointers.get(seen + 1)
        base = np.zeros(len(seen), np.int64)
        base[begin > 0] = self.successors.get(begin[begin > 0] - 1) + 1
        x = base[back] + word
        at = self.successors.successor(x)
        inside = np.flatnonzero(at < end[back])
        hit = inside[self.successors.get(at[inside]) == x[inside]]
        out[hit] = at[hit]
        return out


class Trie3:
    """A trie of three levels with two levels of pointers: words, the words after each, and, below such a pair,
    the words before it.  A word of the third level is not held by its number but by its place among the words
    that come before the pair's first word (Pibiri and Venturini's remapping by context, mirrored); a further
    sequence of these holds what is known of each context of two words.

    ``pairs``: (first, second, level) by rising (first, second); ``contexts``: (before, first, value) by rising
    (first, before); ``triples``: numbers of a pair and a context of the same first word, and a level."""

    def __init__(self, firsts: int, pairs: tuple[np.ndarray, ...], contexts: tuple[np.ndarray, ...], triples: tuple[np.ndarray, ...]):
        before, first, self.value = contexts
        self.pairs = Trie(build_trie(*pairs, firsts))
        self.contexts = Trie(build_trie(first, before, np.zeros(len(first), np.int64), firsts))
        self.begin = np.searchsorted(first, np.arange(firsts))
        pair, context, level = triples
        place = context - self.begin[first[context]]
        order = np.lexsort((place, pair))
        self.triples = Trie(build_trie(pair[order], place[order], level[order], len(pairs[0])))

    def context(self, before: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Numbers of contexts, -1 for none."""
        return self.contexts.at(first, before)

    def triple(self, pair: np.ndarray, context: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Levels of triples, -1 for none; ``pair`` and ``context`` as found for the same ``first``, -1 for none."""
        out = np.full(len(pair), -1, np.int64)
        some = np.flatnonzero((pair >= 0) & (context >= 0))
        out[some] = self.triples.find(pair[some], context[some] - self.begin[first[some]])
        return out
