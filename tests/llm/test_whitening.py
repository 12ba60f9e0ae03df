"""Whitening against numpy's eigenvectors, and the slicing of spectra."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.llm.whitening import eigenvalues_above, fit_whitening, leading_components, whiten

NAN, INF = float("nan"), float("inf")


@given(st.integers(1, 12), st.integers(0, 10_000), st.booleans())
@settings(max_examples=60, deadline=None)
def test_inertia_and_components(size, seed, repeated):
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.normal(size=(size, size)))[0]
    values = np.sort(rng.integers(-3, 4, size) if repeated else rng.normal(size=size))[::-1].astype(float)
    matrix = (basis * values) @ basis.T
    matrix = (matrix + matrix.T) / 2
    for shift in rng.uniform(-4, 4, 5) + 0.0137:
        assert eigenvalues_above(matrix, shift) == (np.linalg.eigvalsh(matrix) > shift).sum()
    found, vectors = leading_components(matrix, 4)
    k = min(4, size)
    assert np.allclose(found, values[:k], atol=1e-10)
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-10)
    assert np.allclose(matrix @ vectors, vectors * found, atol=1e-8)


def expected(rows, k):
    x = np.floor(256.0 * np.array(rows, np.float64))
    fit = np.unique(x, axis=0)
    n = len(fit)
    mean = fit.mean(axis=0)
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    deviation = ((n * x - fit.sum(axis=0)) ** 2).sum(axis=1).astype(np.int64)
    return n, values, (x - mean) @ vectors / np.sqrt(values), deviation


@pytest.mark.parametrize("kind", ["float", "double"])
def test_equals_numpy(spark, kind):
    rng = np.random.default_rng(5)
    rows = (rng.normal(size=(300, 6)) * [5, 1, 3, 1, 1, 2] + 7).astype(np.float32).tolist()
    rows += rows[:90]  # copies count once in the fit
    odd = [(-1, None), (-2, [1.0, NAN, 0.0, 0.0, 0.0, 0.0]), (-3, [INF, 1.0, 0.0, 0.0, 0.0, 0.0]), (-4, [None, 1.0, 0.0, 0.0, 0.0, 0.0]), (-5, []), (-6, [1.0])]
    table = [*enumerate(rows), *odd]
    df = spark.createDataFrame([(i, v, i, "x") for i, v in table], f"vec_id long, embedding array<{kind}>, row long, whitened string").repartition(5)
    model = fit_whitening(df)
    n, values, white, deviation = expected(rows, 4)
    assert model.n == n and np.allclose(model.values, values, rtol=1e-12) and model.identity_error < 1e-9
    got = sorted((r["row"]["vec_id"], r["deviation"], r["whitened"]) for r in whiten(df, model).collect())
    assert [g[0] for g in got] == list(range(len(rows)))
    assert [g[1] for g in got] == deviation.tolist()
    made = np.array([g[2] for g in got])
    assert np.allclose(made * np.sign((made * white).sum(axis=0)), white, atol=1e-9)


def test_flat_and_empty_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert fit_whitening(spark.createDataFrame([], schema)) is None
    assert whiten(spark.createDataFrame([], schema), None).collect() == []
    one = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], schema)
    got = whiten(one, fit_whitening(one)).collect()
    assert [(r["deviation"], r["whitened"]) for r in got] == [(0, [None, None])] * 2
    line = spark.createDataFrame([(1, [0.0, 2.0]), (2, [1.0, 2.0]), (3, [2.0, 2.0])], schema)
    model = fit_whitening(line)
    got = {r["row"]["vec_id"]: r["whitened"] for r in whiten(line, model).collect()}
    assert got[2][0] == pytest.approx(0) and got[1][0] == pytest.approx(-got[3][0]) and got[1][1] is None
    assert model.identity_error < 1e-12


def test_large_entries(spark):
    df = spark.createDataFrame([(k, [1e9 * k, 1e300 if k == 3 else -1.0 * k]) for k in range(4)], "vec_id long, embedding array<double>")
    got = {r["row"]["vec_id"]: r["deviation"] for r in whiten(df, fit_whitening(df)).collect()}
    assert got[3] is None  # beyond a long
    small = spark.createDataFrame([(k, [1e6 * k, -1.0 * k]) for k in range(4)], "vec_id long, embedding array<double>")
    got = {r["row"]["vec_id"]: r["deviation"] for r in whiten(small, fit_whitening(small)).collect()}
    sums = (256_000_000 * 6, -256 * 6)
    assert got == {k: (4 * 256_000_000 * k - sums[0]) ** 2 + (-4 * 256 * k - sums[1]) ** 2 for k in range(4)}
