import math
import random

import numpy as np
import pytest

from digestry.llm import bidiagonal_qd, whitening

SCHEMA = "vec_id long, embedding array<double>, n string, dims string, x int, size long, id string, sums string"


def frame(spark, rows, n=3):
    return spark.createDataFrame([(i, v, "n", "d", 1, 2, "i", "s") for i, v in rows], SCHEMA).repartition(n)


def brute(rows, components=4):
    """{(id, row as tuple): (n, deviation, eigenvalues, total, covariance, offsets)} by numpy's dense solver and Python integers."""
    good = []
    for i, v in rows:
        if v is None or any(c is None or not math.isfinite(c) or not abs(c * 256) < 2**63 for c in v):
            continue
        good.append((i, tuple(math.floor(256 * c) for c in v)))
    out = []
    for d in sorted({len(x) for _, x in good if x}):
        fit = sorted({x for _, x in good if len(x) == d})
        n, s = len(fit), [sum(column) for column in zip(*fit, strict=True)]
        centred = np.array([[(n * a - b) / n for a, b in zip(x, s, strict=True)] for x in fit])
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        values, vectors = values[::-1], vectors[:, ::-1]
        k = int((values[:components] > 1e-18 * d * max(values[0], 0)).sum()) if values[0] > 0 else 0
        k = min(k, n - 1)
        for i, x in good:
            if len(x) == d:
                offset = [n * a - b for a, b in zip(x, s, strict=True)]
                out.append((i, d, n, sum(o * o for o in offset), values, vectors, k, np.array([o / n for o in offset])))
    return out


def check(spark, rows, components=4, tolerance=1e-9):
    got = whitening.whiten(frame(spark, rows), components)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    want = []
    for i, d, n, deviation, values, vectors, k, offset in brute(rows, components):
        for c in range(k):
            want.append((-1 if i is None else i, c + 1, n, deviation, abs(offset @ vectors[:, c]) / math.sqrt(values[c]), values[c] / values.sum()))
    found = sorted((-1 if r.vec_id is None else r.vec_id, r.component, r.n, int(r.deviation), abs(r.whitened), r.explained) for r in got.collect())
    assert [r[:4] for r in found] == [r[:4] for r in sorted(want)]
    if tolerance:
        np.testing.assert_allclose([r[4:] for r in found], [r[4:] for r in sorted(want)], rtol=tolerance, atol=tolerance)
    assert all(r.identity_error < 1e-4 for r in got.collect())
    return got


def vectors(seed, n, d, spread=None):
    random_ = np.random.default_rng(seed)
    mix = random_.standard_normal((d, d)) * (spread if spread is not None else 1 / np.arange(1, d + 1))
    return [(i, [float(c) for c in row]) for i, row in enumerate(random_.standard_normal((n, d)) @ mix.T)]


def test_against_dense_solver(spark):
    check(spark, vectors(1, 400, 9))


def test_copies_count_once_in_the_fit(spark):
    rows = vectors(2, 60, 5)
    check(spark, rows + [(1000 + i, rows[0][1]) for i in range(300)] + [(3, rows[3][1])] * 4)


def test_nulls_lengths_and_limits(spark):
    rows = vectors(3, 80, 6) + [(200, None), (201, [None] * 6), (202, [math.nan] * 6), (203, [math.inf] + [0.0] * 5), (204, []), (None, [0.5] * 6),
                                (205, [1e300] * 6), (206, [1.0, 2.0]), (207, [2.0, 5.0]), (208, [1.5, 0.0]), (209, [-0.0, 0.0]), (210, [7.0])]
    got = check(spark, rows)
    assert got.filter("vec_id in (200, 201, 202, 203, 204, 205, 210)").count() == 0  # 210 is alone in its length
    assert got.filter("vec_id = 206").count() == 2


def test_beyond_64_bits_is_exact(spark):
    rows = [(i, [float(random.Random(i).randint(-(2**44), 2**44)) for _ in range(3)]) for i in range(50)]
    check(spark, rows, tolerance=1e-8)


def test_beyond_38_digits_is_null(spark):
    rows = [(i, [float(random.Random(i).randint(-(2**53), 2**53)) for _ in range(3)]) for i in range(50)]
    got = whitening.whiten(frame(spark, rows))
    assert got.filter("deviation is null").select("vec_id").distinct().count() > 40


def test_one_vector_or_none(spark):
    assert check(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]).count() == 0
    assert check(spark, []).count() == 0


def test_equal_eigenvalues(spark):
    rows = [(2 * i + s, [(1.0 if j == i else 0.0) * (1 - 2 * s) for j in range(6)]) for i in range(6) for s in range(2)]
    got = whitening.whiten(frame(spark, rows)).toPandas()
    assert len(got) == 12 * 4 and (got.identity_error < 1e-12).all()
    np.testing.assert_allclose(got.explained, 1 / 6, rtol=1e-12)


def test_slices_and_merging(spark, monkeypatch):
    monkeypatch.setattr(whitening, "CELLS", 40)
    monkeypatch.setattr(whitening, "FAN", 2)
    rows = vectors(4, 300, 7)
    got = whitening.whiten(frame(spark, rows, 9)).toPandas()
    monkeypatch.undo()
    want = whitening.whiten(frame(spark, rows, 1)).toPandas()
    key = ["vec_id", "component"]
    a, b = got.sort_values(key), want.sort_values(key)
    np.testing.assert_allclose(a.whitened.abs(), b.whitened.abs(), rtol=1e-8, atol=1e-10)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_solver(n):
    random_ = np.random.default_rng(n)
    q, _ = np.linalg.qr(random_.standard_normal((n, n)))
    w, _ = np.linalg.qr(random_.standard_normal((n, n)))
    for matrix in (random_.standard_normal((n, n)), np.eye(n), q @ np.diag(1 + 1e-9 * random_.random(n)) @ w, q @ np.diag(10.0 ** -np.arange(n)) @ w,
                   np.outer(q[0], w[0]), np.diag(np.abs(np.arange(n) - n // 2) + 1.0) + np.diag(np.ones(n - 1), 1), np.zeros((n, n)), 1e150 * q, 1e-150 * q):
        squares, vectors_ = bidiagonal_qd.leading(matrix, 4)
        want = np.linalg.svd(matrix, compute_uv=False)[: len(squares)]
        assert len(squares) == min(4, n, np.linalg.matrix_rank(matrix, tol=n * 2.0**-52 * (np.abs(want).max(initial=0)))) or not matrix.any()
        np.testing.assert_allclose(np.sqrt(squares), want, rtol=1e-10)
        np.testing.assert_allclose(vectors_ @ vectors_.T, np.eye(len(squares)), atol=1e-11)
        top = want[0] if len(want) else 1.0
        scaled = matrix / top
        np.testing.assert_allclose(scaled.T @ (scaled @ vectors_.T), vectors_.T * (squares / top / top), atol=1e-13 * n)


def test_dqds_keeps_small_values_accurate():
    # a graded bidiagonal matrix: every singular value to nearly full relative accuracy
    diagonal, above = [10.0 ** (-3 * k) for k in range(8)], [10.0 ** (-3 * k) for k in range(7)]
    found = bidiagonal_qd.dqds(diagonal, above)
    from decimal import Decimal, getcontext

    getcontext().prec = 80
    product = Decimal(1)
    for x in found:
        product *= Decimal(x)
    exact = Decimal(1)
    for x in diagonal:
        exact *= Decimal(x) ** 2
    assert abs(product / exact - 1) < Decimal("1e-13")
