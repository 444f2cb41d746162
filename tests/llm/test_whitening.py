from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from postloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int"


def rows_of(got):
    return {(r.vec_id, r.component): r for r in got.collect()}


def brute(vectors):
    """n, sums, exact deviations, and the eigenvalues and vectors of the exact covariance, by a full decomposition."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(v, s)) for v in x]
    mean = [Fraction(t, n) for t in s]
    y = [[c - m for c, m in zip(v, mean)] for v in x]
    d = len(s)
    cov = np.array([[float(sum(v[i] * v[j] for v in y) / n) for j in range(d)] for i in range(d)])
    e, axes = np.linalg.eigh(cov)
    return n, deviation, e[::-1], axes[:, ::-1], np.array([[float(c) for c in v] for v in y])


def test_against_a_full_decomposition(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((150, 12)) @ np.diag(np.linspace(0.1, 2, 12)) @ rng.standard_normal((12, 12))).astype(np.float32)
    got = rows_of(whitening.whiten(spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vectors)], SCHEMA).repartition(5)))
    n, deviation, e, axes, y = brute(vectors)
    assert len(got) == 150 * 8
    for c in range(8):
        want = y @ axes[:, c] / e[c] ** 0.5
        mine = np.array([got[k, c + 1].whitened for k in range(150)])
        assert np.allclose(mine * np.sign(mine @ want), want, atol=1e-9)
        assert got[0, c + 1].explained == pytest.approx(e[c] / e.sum(), rel=1e-10)
    assert all(got[k, 1].deviation == deviation[k] == got[k, 1].deviation_exact and got[k, 1].n == n for k in range(150))
    assert len({r.identity_error for r in got.values()}) == 1 and got[0, 1].identity_error < 1e-9


@pytest.mark.parametrize("spectrum", [[5, 5, 5, 3, 3, 1, 1, 1, 1, 1], [1, 0.5, 0, 0, 0, 0], [1e12, 1, 1e-2, 1e-3], [3, 3 - 1e-9, 3 - 2e-9, 1, 0.5], [2.0], [4, 4, 4, 4]])
def test_spectra(spectrum):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((len(spectrum),) * 2))[0]
    a = q @ np.diag(spectrum) @ q.T
    values, axes = whitening.Spectrum(a).vectors(8)
    top = [s for s in sorted(spectrum, reverse=True)[:8] if s > 1e-13 * sum(spectrum)]
    assert len(values) == len(top) and np.allclose(values, top, atol=1e-12 * sum(spectrum))
    assert np.allclose(axes.T @ axes, np.eye(len(top)), atol=1e-10)
    assert np.abs(a @ axes - axes * values).max() < 1e-12 * sum(spectrum)


def test_counts_of_shifted_matrices():
    rng = np.random.default_rng(5)
    for size in (1, 2, 3, 10, 40):
        a = rng.standard_normal((size, size))
        a = a + a.T
        e, b = np.linalg.eigvalsh(a), rng.standard_normal(size)
        for shift in [*(e[:-1] + np.diff(e) / 2), e[0] - 1, e[-1] + 1]:
            shifted = a - shift * np.eye(size)
            f = whitening.Factors(shifted)
            assert f.positive == (e > shift).sum()
            assert np.allclose(shifted @ f.solve(b), b, atol=1e-8)
    assert whitening.Factors(np.array([[0.0, 1.0], [1.0, 0.0]])).positive == 1 and whitening.Factors(np.zeros((3, 3))).positive == 0


def test_exact_sums_of_large_entries():
    x = np.array([[3**30, -(2**51)], [5, 7], [2**51, 1]], np.int64)
    assert whitening.exact_products(x).tolist() == [[sum(int(r[i]) * int(r[j]) for r in x) for j in range(2)] for i in range(2)]
    assert whitening.exact_total(np.full((4, 1), 2**61, np.int64)).tolist() == [2**63]


def test_defined_cases(spark):
    bad = [(1, None), (2, []), (3, [1.0, None]), (4, [math.nan, 1.0]), (5, [math.inf, 0.0]), (6, [1e20, 0.0]), (7, [1.0, 2.0, 3.0])]
    good = [(10, [0.0, 1.0]), (11, [2.0, 0.5]), (None, [1.0, -1.0]), (11, [2.0, 0.5])]
    df = lambda rows: spark.createDataFrame([(k, v, 9) for k, v in rows], SCHEMA)
    got = whitening.whiten(df(bad + good)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (10, 1), (10, 2), (11, 1), (11, 1), (11, 2), (11, 2)] and got[0].n == 4
    _, deviation, *_ = brute([v for _, v in good])
    assert {r.deviation for r in got} == set(deviation)
    for rows in (bad[:6], [], good[:1], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]):
        assert whitening.whiten(df(rows)).count() == 0
    line = whitening.whiten(df([(k, [k / 8, k / 4]) for k in range(9)])).collect()
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1, abs=1e-6)


def test_deviation_beyond_a_long(spark):
    vectors = [[2.0**40, 0.0], [-(2.0**40), 1.0], [0.0, 3.0]]
    got = rows_of(whitening.whiten(spark.createDataFrame([(k, v, 0) for k, v in enumerate(vectors)], SCHEMA)))
    _, deviation, *_ = brute(vectors)
    assert [int(got[k, 1].deviation_exact) for k in range(3)] == deviation
    assert got[0, 1].deviation is None and got[2, 1].deviation == (deviation[2] if deviation[2] < 2**63 else None)


def test_query_on_given_vectors(spark):
    sf = "/root/testdata/sf0.01"
    vectors = [r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    got = rows_of(whitening.op13_embedding_whitening(spark, sf))
    n, deviation, e, axes, y = brute(vectors)
    for c in range(8):
        want = y @ axes[:, c] / e[c] ** 0.5
        mine = np.array([got[k, c + 1].whitened for k in range(n)])
        assert np.allclose(mine * np.sign(mine @ want), want, atol=1e-8)
    assert [got[k, 1].deviation for k in range(n)] == deviation and got[0, 8].identity_error < 1e-4
