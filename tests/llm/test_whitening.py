"""Whitening against double-precision algebra, and its exact parts against plain integers."""

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from docweave.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, component string, x int, z double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", 1, 2.0) for i, v in rows], SCHEMA).repartition(3)


def test_rows_equal_plain_algebra(spark):
    draw = np.random.default_rng(8)
    points = (draw.normal(size=(400, 9)) @ draw.normal(size=(9, 9)) / 4).astype(np.float32)
    nan, inf = float("nan"), float("inf")
    rows = [(i, v.tolist()) for i, v in enumerate(points)] + [(1000 + i, points[5].tolist()) for i in range(90)] + [(None, points[6].tolist()), (7, points[7].tolist())]
    odd = [(1, None), (2, []), (3, [nan] * 9), (4, [1.0] * 8 + [None]), (5, [inf] + [0.0] * 8), (6, [1.0] * 8)]
    found = wh.whiten(frame(spark, rows + odd)).collect()
    assert len(found) == 4 * len(rows)
    x = np.floor(256 * np.array([v for _, v in rows], dtype=np.float64)).astype(int)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    by_id = {}
    for r in found:
        by_id.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    assert {r["n"] for r in found} == {n} and len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9
    for c in range(1, 5):
        wanted = (x - sums / n) @ vectors[:, c - 1] / np.sqrt(values[c - 1])
        got = np.array([by_id[i][c][0]["whitened"] for i, _ in rows])
        assert np.allclose(got, wanted * np.sign(got[0] * wanted[0]), rtol=1e-9, atol=1e-9)
        assert abs(by_id[0][c][0]["explained"] / (values[c - 1] / values.sum()) - 1) < 1e-9
    for (i, _), v in zip(rows, x):
        assert {r["deviation"] for c in by_id[i].values() for r in c} == {int(((n * v - sums) ** 2).sum())}
    assert len(by_id[7][1]) == 2 and len(by_id[None][1]) == 1


def test_few_dimensions_equal_rows_and_empty_tables(spark):
    assert wh.whiten(frame(spark, [])).count() == 0
    assert wh.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    assert wh.whiten(frame(spark, [(i, [0.5, 0.25]) for i in range(5)])).count() == 0
    line = wh.whiten(frame(spark, [(i, [i / 4, i / 2, -i / 4]) for i in range(6)])).collect()
    assert sorted((r["vec_id"], r["component"]) for r in line) == [(i, 1) for i in range(6)] and abs(line[0]["explained"] - 1) < 1e-12
    # Two equal roots: any two directions across will do.
    square = wh.whiten(frame(spark, [(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, -1.0])])).collect()
    assert len(square) == 8 and {round(r["explained"], 12) for r in square} == {0.5} and square[0]["identity_error"] < 1e-12


def test_long_entries_stay_exact(spark):
    rows = [(i, [float(2**40 * (i % 5)), float(i * i)]) for i in range(20)]
    found = wh.whiten(frame(spark, rows)).collect()
    x = [[int(256 * np.float32(v)) for v in row] for _, row in rows]
    n, sums = len({tuple(v) for v in x}), [sum(c) for c in zip(*{tuple(v) for v in x})]
    exact = {i: sum((n * v - s) ** 2 for v, s in zip(row, sums)) for i, row in enumerate(x)}
    assert {(r["vec_id"], r["deviation"]) for r in found} == {(i, v if v < 2**63 else None) for i, v in exact.items()}
    assert found[0]["identity_error"] < 1e-6


def test_moments_of_tasks_are_exact(spark):
    draw = np.random.default_rng(2)
    for reach in (100, 1 << 30, 1 << 55):
        x = draw.integers(-reach, reach, size=(60, 3))
        found = wh.moments(spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(4), 3)
        wide = x.astype(object)
        assert found.n == 60 and found.sums == wide.sum(axis=0).tolist()
        assert found.scatter == (60 * (wide.T @ wide) - np.outer(wide.sum(axis=0), wide.sum(axis=0))).tolist()


def plain_polynomial(matrix):
    """det(t - matrix) by traces of products, in fractions."""
    d = len(matrix)
    a = [[Fraction(v) for v in row] for row in matrix]
    product, out = [[Fraction(int(i == j)) for j in range(d)] for i in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        moved = [[sum(a[i][m] * product[m][j] for m in range(d)) for j in range(d)] for i in range(d)]
        c = -sum(moved[i][i] for i in range(d)) / k
        out.append(c)
        product = [[moved[i][j] + (c if i == j else 0) for j in range(d)] for i in range(d)]
    return [int(c) for c in reversed(out)]


@pytest.mark.parametrize("d, reach", [(1, 5), (2, 9), (6, 1000), (12, 10**9)])
def test_polynomials_are_exact(spark, d, reach):
    draw = np.random.default_rng(d)
    half = draw.integers(-reach, reach + 1, size=(d, d)).astype(object)
    half[:, d // 2] = 0  # and a root at 0
    matrix = (half @ half.T).tolist()
    assert wh.characteristic_polynomial(spark, matrix) == plain_polynomial(matrix)
    sparse = [[7 if i == j else 0 for j in range(d)] for i in range(d)]
    assert wh.characteristic_polynomial(spark, sparse) == plain_polynomial(sparse)


def test_roots_with_multiplicity():
    # (t - 9)^2 (t - 2) t, and roots at 3 - sqrt 2, 3 + sqrt 2
    twice = [0, -162, 117, -20, 1]
    assert [(a / 2**b, m) for a, b, m in wh.largest_roots(twice, 4)] == [(9.0, 2), (2.0, 1)]
    assert [m for _, _, m in wh.largest_roots(twice, 1)] == [2]
    near = wh.largest_roots([7, -6, 1], 2)
    assert [m for *_, m in near] == [1, 1]
    for (a, b, _), sign in zip(near, (1, -1)):
        assert abs((Fraction(a, 2**b) - 3) ** 2 - 2) < Fraction(1, 2**200) and (a / 2**b > 3) == (sign > 0)


def test_long_columns_of_arrow():
    x = np.array([[1 << 26, 3], [-(1 << 30), 5]])
    assert wh.exact_products(x).tolist() == (x.astype(object).T @ x.astype(object)).tolist()
    assert wh._matrix(pa.array([], pa.list_(pa.int64()))).shape == (0, 0)
    assert sum(digit << (32 * k) for k, digit in wh._limbs(-(3 << 70) + 5)) == -(3 << 70) + 5
