"""Embedding whitening by QDWH spectral divide-and-conquer.

A vector is judged by its integer entries ``floor(64 * c) + 1000000``.  The fit list
holds every distinct integer vector once; mean, covariance (divisor n, entries centred
before they are multiplied) and the check of the result are over that list.

Method.  The polar factor of ``covariance - shift * I``, found by the dynamically
weighted Halley iteration in its QR form (QDWH), has eigenvalues 1 and -1, so
``(factor + I) / 2`` projects on the invariant subspace of the eigenvalues above the
shift.  Orthonormal bases of the two subspaces split the covariance into two smaller
ones, which are split in turn until single components are left.  The whitening matrix is
sent to all tasks, which project all rows of the table.

What Spark does.  Entries become bytes in Arrow batches; one aggregate, combined
map-side, leaves distinct vectors (a vector that fills a third of the table is one row
a task).  The list is written once and read three times: exact sums, centred products,
and the check.  Tasks send one number per pair of dimensions, summed by Spark; the driver
holds ``dimensions ** 2`` numbers, whatever the number of rows.

Left out are rows whose vector is NULL, holds NULL or non-finite entries or entries of
``2 ** 56`` and more (their integers fit no long), and, should lengths differ, all but
those of the commonest length (of two, the longer).  Components whose eigenvalue is not
above ``RANK`` times the largest cannot be whitened and are left out; so are all if there
is one distinct vector only.  A deviation that fits no long is NULL.  Repeated ids are
separate rows.  Empty tables, or tables of empty vectors, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.text import lean
from weekpanel.session import materialize

SCALE, BASE = 64, 1_000_000
COMPONENTS = 16
RANK = 1e-12
LARGEST = 2.0**56
EPS = np.finfo(float).eps

# --------------------------------------------------------------------------- the spectral part


def polar(a: np.ndarray, least: float = 1e-15) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix whose singular values, over its Frobenius norm,
    are at least ``least``: QDWH, six or seven QR steps."""
    n = len(a)
    x, low = a / np.linalg.norm(a), least
    for _ in range(40):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        weight = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
        last, x = x, b / c * x + (weight - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        low = min(1.0, low * (weight + b * square) / (1 + c * square))
        if 1 - low < 8 * EPS and np.linalg.norm(x - last) < 1e-10 * np.sqrt(n):
            break
    return (x + x.T) / 2


def _basis(projector: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """Orthonormal basis of a projector's range."""
    q = np.random.default_rng(seed).standard_normal((len(projector), rank))
    for _ in range(3):
        q, _ = np.linalg.qr(projector @ q)
    return q


def _split(a: np.ndarray, scale: float):
    """Bases of two invariant subspaces of ``a``, or None if it is a multiple of the identity to precision."""
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    if spread <= n * EPS * scale:
        return None
    shifts = [np.median(np.diag(a)), mean, *(mean + spread * f for f in (0.3, -0.3, 0.1, -0.1, 0.03, -0.03, 0.7, -0.7))]
    best = None
    for shift in shifts:  # a shift that meets an eigenvalue leaves a rest; the next one is tried then
        factor = polar(a - shift * np.eye(n))
        above = (factor + np.eye(n)) / 2
        rank = int(round(np.trace(above)))
        if not 0 < rank < n:
            continue
        one, two = _basis(above, rank, n), _basis(np.eye(n) - above, n - rank, n + 1)
        rest = max(np.linalg.norm(two.T @ a @ one), scale * np.linalg.norm(two.T @ one))
        if best is None or rest < best[0]:
            best = rest, one, two
        if rest <= 10 * n * EPS * scale:
            break
    return best and best[1:]


def _components(a: np.ndarray, scale: float) -> np.ndarray:
    if len(a) == 1:
        return np.eye(1)
    parts = _split(a, scale)
    if parts is None:
        return np.eye(len(a))
    done = []
    for basis in parts:
        inner = basis.T @ a @ basis
        done.append(basis @ _components((inner + inner.T) / 2, scale))
    return np.hstack(done)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    scale = np.linalg.norm(a)
    if scale == 0:
        return np.zeros(len(a)), np.eye(len(a))
    v = _components(a, scale)
    v = v @ (3 * np.eye(len(a)) - v.T @ v) / 2  # one Newton step to orthonormal columns
    values = np.einsum("ij,ij->j", v, a @ v)
    order = np.argsort(-values, kind="stable")
    return values[order], v[:, order]


# --------------------------------------------------------------------------- vectors in Arrow batches


def _entries(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integers less ``BASE``) of the whole vectors of an Arrow list column, length by length."""
    import pyarrow as pa

    offsets = column.offsets.to_numpy()
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~(np.abs(values) < LARGEST))])  # NULL reads as NaN
    length = np.diff(offsets)
    whole = column.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])
    for size in np.unique(length[whole]):
        rows = np.flatnonzero(whole & (length == size))
        yield rows, np.floor(SCALE * values[offsets[rows][:, None] + np.arange(size)]).astype(np.int64)


WIDTHS = (np.int16, np.int32, np.int64)


def _pack(matrix: np.ndarray) -> list[bytes]:
    """Each row as bytes of the least width that holds it, after a byte that names the width."""
    low, high = matrix.min(1, initial=0), matrix.max(1, initial=0)
    out: list = [None] * len(matrix)
    left = np.ones(len(matrix), bool)
    for code, kind in enumerate(WIDTHS):
        fits = left & (low >= np.iinfo(kind).min) & (high <= np.iinfo(kind).max)
        left &= ~fits
        rows = np.flatnonzero(fits)
        raw, step, head = matrix[rows].astype(kind).tobytes(), matrix.shape[1] * kind().itemsize, bytes([code])
        for i, r in enumerate(rows):
            out[r] = head + raw[i * step : (i + 1) * step]
    return out


def _unpack(packed: list[bytes], dims: int) -> np.ndarray:
    out = np.empty((len(packed), dims), np.int64)
    code = np.frombuffer(b"".join(p[:1] for p in packed), np.uint8)
    for c, kind in enumerate(WIDTHS):
        rows = np.flatnonzero(code == c)
        if len(rows):
            out[rows] = np.frombuffer(b"".join(packed[r][1:] for r in rows), kind).reshape(len(rows), dims)
    return out


def _key_batches(batches):
    import pyarrow as pa

    for batch in batches:
        for _, matrix in _entries(batch.column(0)):
            if matrix.shape[1]:
                dims = pa.array(np.full(len(matrix), matrix.shape[1], np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(_pack(matrix), pa.binary()), dims], ["x", "dims"])


def distinct_vectors(rows: DataFrame) -> tuple[DataFrame, int]:
    """The fit list ``(x)`` of ``rows(embedding)``, written, and its number of dimensions."""
    keys = rows.select("embedding").mapInArrow(lean(_key_batches), "x binary, dims int")
    found = materialize(keys.groupBy("x", "dims").agg(F.count(F.lit(1)).alias("copies")), "vectors")
    dims = found.groupBy("dims").agg(F.sum("copies").alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    size = dims[0]["dims"] if dims else 0
    return found.filter(F.col("dims") == size).select("x"), size


def _sum_batches(dims: int):
    def run(batches):
        import pyarrow as pa

        n, total = 0, [0] * dims
        for batch in batches:
            x = _unpack(batch.column(0).to_pylist(), dims)
            high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)  # no overflow, whatever the entries
            total = [t + (int(h) << 32) + int(l) for t, h, l in zip(total, high, low)]
            n += len(x)
        if n:
            values = pa.array([Decimal(v) for v in [n, *total]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), values], ["i", "v"])

    return lean(run)


def _product_batches(dims: int, center: np.ndarray, matrix: np.ndarray | None = None):
    """Sums of the products of centred entries, after a projection if one is given: a row per pair of columns."""

    def run(batches):
        import pyarrow as pa

        wide = dims if matrix is None else matrix.shape[1]
        total, seen = np.zeros((wide + 1, wide)), False
        for batch in batches:
            y = _unpack(batch.column(0).to_pylist(), dims) - center
            y = y if matrix is None else y @ matrix
            total[:wide] += y.T @ y
            total[wide] += y.sum(0)
            seen = True
        if seen:
            i, j = np.divmod(np.arange(total.size), wide)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    return lean(run)


def _covariance(vectors: DataFrame, n: int, dims: int, center: np.ndarray, matrix: np.ndarray | None = None) -> np.ndarray:
    wide = dims if matrix is None else matrix.shape[1]
    sent = vectors.mapInArrow(_product_batches(dims, center, matrix), "i int, j int, v double")
    out = np.zeros((wide + 1, wide))
    for i, j, v in sent.groupBy("i", "j").agg(F.sum("v")).collect():  # (dimensions + 1) x dimensions rows
        out[i, j] = v
    mean = out[wide] / n  # what rounding left of the centring
    return out[:wide] / n - np.outer(mean, mean)


class Whitening:
    """A fitted whitening: ``n`` and ``sums`` exact (sums of entries less ``BASE``), ``matrix`` maps centred
    vectors to whitened components, ``explained`` their shares of the trace, ``identity_error`` the largest
    entry by which the covariance of the whitened fit list departs from the identity."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.dims = n, sums, len(sums)
        self.center = np.array([s / n for s in sums])
        self.matrix = vectors / np.sqrt(values)
        self.explained = values / trace
        self.identity_error = 0.0


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fits the leading ``components`` on the distinct vectors of ``rows(embedding)``; None if there is nothing to whiten."""
    vectors, dims = distinct_vectors(rows)
    if not dims:
        return None
    sent = vectors.mapInArrow(_sum_batches(dims), "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v")).collect()
    by_dim = {i: int(v) for i, v in sent}  # dimensions + 1 rows
    n, sums = by_dim.pop(-1), [by_dim[i] for i in range(dims)]
    center = np.array([s / n for s in sums])
    covariance = _covariance(vectors, n, dims, center)
    values, found = eigen((covariance + covariance.T) / 2)
    kept = int(((values > RANK * values[0]) & (values > 0)).sum()) if values[0] > 0 else 0
    kept = min(kept, components)
    if not kept:
        return None
    model = Whitening(n, sums, values[:kept], found[:, :kept], float(np.trace(covariance)))
    white = _covariance(vectors, n, dims, center, model.matrix)
    model.identity_error = float(np.abs(white - np.eye(kept)).max())
    return model


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over dimensions of ``(n * x - sum) ** 2``; None where they fit no long."""
    near = np.square(n * x.astype(float) - np.array([float(s) for s in sums])).sum(1)
    small = near < 2.0**62
    out: list[int | None] = [None] * len(x)
    if small.any() and n * int(np.abs(x).max(initial=0)) < 2**62 and max(map(abs, sums)) < 2**62:
        exact = np.square(n * x[small] - np.array(sums, np.int64)).sum(1)
        for r, v in zip(np.flatnonzero(small), exact.tolist()):
            out[r] = v
    for r in np.flatnonzero([v is None for v in out]):
        v = sum((n * int(e) - s) ** 2 for e, s in zip(x[r], sums)) if near[r] < 2.0**64 else 2**63
        out[r] = v if v < 2**63 else None
    return out


WHITE = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _white_batches(shared):
    def run(batches):
        import pyarrow as pa

        model = shared.value
        k = model.matrix.shape[1]
        for batch in batches:
            for rows, x in _entries(batch.column(1)):
                if x.shape[1] != model.dims:
                    continue
                white = (x - model.center) @ model.matrix
                m = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(rows, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n)),
                        pa.array(_deviations(x, model.n, model.sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(white.ravel()),
                        pa.array(np.tile(model.explained, m)),
                        pa.array(np.full(m * k, model.identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return lean(run)


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per whole vector of ``rows(vec_id, embedding)`` and component, numbered from 1 by falling eigenvalue."""
    spark = rows.sparkSession
    schema = WHITE.format(rows.schema["vec_id"].dataType.simpleString())
    model = fit_whitening(rows, components)
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)  # dimensions x components numbers
    return rows.select("vec_id", "embedding").mapInArrow(_white_batches(shared), schema)
