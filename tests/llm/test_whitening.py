"""Whitening against a plain eigendecomposition of the distinct integer vectors."""

import numpy as np
import pytest

from weekpanel.llm import whitening
from weekpanel.llm.whitening import eigen, polar, whiten

SCHEMA = "vec_id long, embedding array<double>, component int, x string, dims int, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], 5, "x", 6, "n") for i, v in rows], SCHEMA)


def result(spark, rows, **options):
    return whiten(frame(spark, rows), **options).toPandas().sort_values(["vec_id", "component"], ignore_index=True)


def check(spark, rows, dims):
    """Compares all columns with exact integers and numpy's eigh (components up to their sign)."""
    got = result(spark, rows)
    whole = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(e is not None and np.isfinite(e) for e in v)]
    ints = [[int(np.floor(64 * float(e))) + 1_000_000 for e in v] for _, v in whole]
    fit = sorted(set(map(tuple, ints)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    k = min(16, int((values > 1e-9 * values.max()).sum()))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == k * len(whole) and set(got.n) == {n}
    assert got.identity_error.nunique() == 1 and got.identity_error[0] <= 1e-9
    for c in range(1, k + 1):
        part = got[got.component == c]
        assert np.allclose(part.explained, values[c - 1] / values.sum(), rtol=1e-9)
        order = np.argsort([i for i, _ in whole], kind="stable")
        want = (np.array(ints)[order] - np.array(sums) / n) @ vectors[:, c - 1] / np.sqrt(values[c - 1])
        if np.min(np.abs(np.delete(values, c - 1) - values[c - 1]), initial=np.inf) > 1e-6 * values[0]:
            assert min(np.abs(part.whitened - want).max(), np.abs(part.whitened + want).max()) < 1e-6
    exact = sorted((i, sum((n * e - s) ** 2 for e, s in zip(x, sums))) for (i, _), x in zip(whole, ints))
    assert sorted(zip(got[got.component == 1].vec_id, got[got.component == 1].deviation)) == exact


@pytest.mark.parametrize("dims", [1, 2, 5, 40])
def test_equals_eigh(spark, dims):
    rng = np.random.default_rng(dims)
    points = rng.standard_normal((300, dims)) * np.linspace(1, 4, dims)
    rows = [(i, p) for i, p in enumerate(points)]
    rows += [(1000 + i, points[0]) for i in range(400)]  # one vector in most rows
    rows += [(2000, None), (2001, [None] * dims), (2002, [float("nan")] * dims), (2003, [float("inf")] * dims), (2004, [1.0] * (dims + 1)), (2005, [])]
    check(spark, rows, dims)


def test_fewer_dimensions_than_columns(spark):
    rng = np.random.default_rng(3)
    flat = rng.integers(-9, 9, (200, 2)) @ rng.integers(-3, 3, (2, 6))
    check(spark, [(i, p) for i, p in enumerate(flat)], 6)


def test_equal_eigenvalues(spark):
    corners = np.vstack([np.eye(4), -np.eye(4)]) * 3
    check(spark, [(i, p) for i, p in enumerate(corners)], 4)


def test_nothing_to_whiten(spark):
    assert len(result(spark, [])) == 0
    assert len(result(spark, [(1, None), (2, [])])) == 0
    assert len(result(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])) == 0


def test_large_entries(spark):
    rows = [(1, [2.0**50, 0.0]), (2, [-(2.0**50), 1.0]), (3, [0.0, 5.0]), (4, [1e300, 1.0])]
    got = result(spark, rows)
    assert got.vec_id.tolist() == [1, 2, 3]
    assert got.deviation.isna().tolist() == [True, True, False] and got.deviation[2] == (3 * 320 - 384) ** 2


def test_exact_deviations_beyond_machine_words():
    n, sums = 3 * 10**9, [7 * 10**9, -(10**10)]
    x = np.array([[2, -3], [4, 1]])
    want = [sum((n * int(e) - s) ** 2 for e, s in zip(r, sums)) for r in x]
    assert whitening._deviations(x, n, sums) == [w if w < 2**63 else None for w in want]


def test_packed_vectors_come_back():
    x = np.array([[1, -2], [40_000, 0], [2**40, -(2**40)], [0, 0]])
    assert (whitening._unpack(whitening._pack(x), 2) == x).all()


def test_polar_factor_and_eigenvectors():
    rng = np.random.default_rng(0)
    for size in (1, 2, 9, 33):
        a = rng.standard_normal((size, size))
        a = a + a.T
        u = polar(a)
        values, vectors = np.linalg.eigh(a)
        assert np.allclose(u, vectors @ np.diag(np.sign(values)) @ vectors.T, atol=1e-10)
        spread = a @ a * np.logspace(0, -8, size)[:, None] * np.logspace(0, -8, size)
        e, v = eigen(spread)
        scale = np.linalg.norm(spread)
        assert np.allclose(v.T @ v, np.eye(size), atol=1e-12) and np.linalg.norm(spread @ v - v * e) < 1e-13 * scale
        assert np.allclose(np.sort(e), np.linalg.eigvalsh(spread), atol=1e-13 * scale)
