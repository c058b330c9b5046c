"""The eigensolver against numpy's, whitening against plain formulas, and odd input."""

import numpy as np
import pytest
from plyforge.llm import whitening


@pytest.mark.parametrize("d", [1, 2, 3, 8, 33, 64])
def test_jacobi_against_numpy(d):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(4 * d, d))
    m = x.T @ x
    values, vectors = whitening.jacobi(m)
    assert np.allclose(values, np.linalg.eigvalsh(m)[::-1], rtol=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-13 * d
    assert np.abs(m @ vectors - vectors * values).max() < 1e-12 * values[0]


def test_small_eigenvalues_keep_their_digits():
    """A graded matrix: eigenvalues over 24 orders of magnitude, each to ten digits. Solvers that reduce the matrix lose the small ones."""
    scale = 10.0 ** -np.arange(0, 13)
    core = np.full((13, 13), 0.3) + 0.7 * np.eye(13)
    m = core * scale[:, None] * scale[None, :]
    values, _ = whitening.jacobi(m)
    from fractions import Fraction

    # The product of all eigenvalues is the determinant, (0.7**12) * (0.7 + 13 * 0.3) times the squares of the scales.
    want = Fraction(7, 10) ** 12 * (Fraction(7, 10) + 13 * Fraction(3, 10)) * Fraction(10) ** -(2 * sum(range(13)))
    got = Fraction(1)
    for v in values:
        got *= Fraction(float(v))
    assert abs(float(got / want) - 1) < 1e-10
    assert (values > 0).all()


def test_repeated_and_absent_eigenvalues():
    values, vectors = whitening.jacobi(np.diag([2.0, 5.0, 2.0, 0.0]))
    assert values.tolist() == [5.0, 2.0, 2.0, 0.0]
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() == 0


def rows_of(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v) for i, v in zip(ids or range(len(vectors)), vectors, strict=True)], "vec_id long, embedding array<float>")


def test_against_formulas(spark):
    rng = np.random.default_rng(7)
    c = (rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40))).astype(np.float32)
    got = whitening.whiten(rows_of(spark, c.tolist())).toPandas()
    x = np.floor(64 * c.astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    y = x - s / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    assert len(got) == 300 * 32 and (got.n == n).all()
    assert (got.groupby("vec_id").deviation.first().to_numpy() == ((n * x - s) ** 2).sum(1)).all()
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = y @ vectors / np.sqrt(values)
    sign = np.sign((w * want).sum(0))
    assert np.abs(w - want * sign).max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), values / np.trace(y.T @ y / n), rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10


def test_odd_input(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0, 5.0], [2.0, 1.0, 5.0], None, [1.0, None, 5.0], [nan, 1.0, 5.0], [inf, 0.0, 5.0], [1.0, 2.0, 5.0], [], [9.0], [3.0, 3.5, 5.0], [3.0e38, 0.0, 1.0]]
    ids = [1, 2, 3, 4, 5, 6, 1, 8, 9, None, 10]
    df = rows_of(spark, vectors, ids).selectExpr("*", "1 AS component", "2 AS n", "'x' AS whitened")
    got = whitening.whiten(df).collect()
    # Four vectors stay (the repeated one twice); the third dimension is constant, so there are two components.
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)]
    assert {r.n for r in got} == {4} and got[0].identity_error < 1e-12
    x = np.floor(64 * np.array([[1, 2, 5], [2, 1, 5], [1, 2, 5], [3, 3.5, 5.0]])).astype(int) + 1_000_000
    dev = ((4 * x - x.sum(0)) ** 2).sum(1)
    assert {r.deviation for r in got if r.vec_id == 1} == {dev[0]} and {r.deviation for r in got if r.vec_id is None} == {dev[3]}


def test_nothing_to_fit(spark):
    assert whitening.whiten(rows_of(spark, [None, []])).collect() == []
    assert whitening.whiten(rows_of(spark, [[1.0, 2.0]] * 3)).collect() == []
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_deviation_beyond_64_bits_is_null(spark):
    got = whitening.whiten(spark.createDataFrame([(1, [1e13]), (2, [-1e13]), (3, [0.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: r.deviation for r in got} == {1: None, 2: None, 3: 0}
    assert abs(got[0].whitened) == pytest.approx(1.5**0.5)
