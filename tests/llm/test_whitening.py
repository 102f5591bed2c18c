import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from driftspark.llm import whitening as W

SF = "/root/testdata/sf0.01"


def brute(vectors):
    """Quantised rows, fit list, covariance in exact integers over n, and LAPACK's eigenpairs."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    fit = sorted({tuple(v) for v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array([[n * c - s for c, s in zip(v, sums)] for v in fit], dtype=object)
    covariance = np.array((z.T @ z) / (n ** 3), dtype=np.float64)
    values, vectors = np.linalg.eigh(covariance)
    return x, n, sums, covariance, values[::-1], vectors[:, ::-1]


def test_equals_brute_force(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    x, n, sums, covariance, values, vectors = brute(table["embedding"])
    rows = W.op11_query(spark, SF).collect()
    assert len(rows) == 16 * len(x)
    of = {i: v for i, v in zip(table["vec_id"], x)}
    signs = {}
    for r in rows:
        v, j = of[r.vec_id], r.component - 1
        d = [n * c - s for c, s in zip(v, sums)]
        assert r.n == n and r.deviation == sum(c * c for c in d)
        want = float(np.array(d, dtype=np.float64) / n @ vectors[:, j] / math.sqrt(values[j]))
        sign = signs.setdefault(j, 1 if want * r.whitened >= 0 or abs(want) < 1e-6 else -1)
        assert r.whitened == pytest.approx(sign * want, abs=1e-8)
        assert r.explained == pytest.approx(values[j] / np.trace(covariance), rel=1e-9)
        assert r.identity_error < 1e-9
    white = {j: [r.whitened for r in rows if r.component == j] for j in (1, 16)}
    assert all(abs(np.var(w) - 1) < 0.05 for w in white.values())


@pytest.mark.parametrize("d,seed", [(1, 0), (2, 1), (3, 2), (24, 3), (90, 4)])
def test_eigenpairs_against_lapack(d, seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((d, 3 * d))
    a = a @ a.T
    values, vectors = W.eigenpairs(a, min(16, d))
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:16], rtol=1e-12, atol=1e-12 * values[0])
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * values[0] * d
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_clusters_keep_orthogonal_vectors():
    """Equal, nearly equal and zero eigenvalues, in a turned basis and in a split matrix."""
    rng = np.random.default_rng(9)
    q, _ = np.linalg.qr(rng.standard_normal((30, 30)))
    spectrum = np.array([5.0] * 6 + [5.0 - 1e-13, 5.0 - 1e-9, 4.9999, 2, 2, 2] + [1e-7] * 6 + [0.0] * 12)
    for a in ((q * spectrum) @ q.T, np.diag(spectrum[::-1]), np.zeros((6, 6)) + np.eye(6)):
        a = (a + a.T) / 2
        k = min(16, len(a))
        values, vectors = W.eigenpairs(a, k)
        assert np.allclose(values, np.sort(np.linalg.eigvalsh(a))[::-1][:k], atol=1e-13 * 30)
        assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * 5 * 3
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12


def test_sturm_counts():
    diag, off = np.array([2.0, 1.0, 0.0, 3.0]), np.array([1.0, 0.0, 0.5])
    values = np.linalg.eigvalsh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1))
    at = np.array([-1.0, 0.1, 1.1, 2.0, 2.9, 4.0])
    assert W.below(diag, off, at).tolist() == [(values < t).sum() for t in at]


SCHEMA = "vec_id long, embedding array<float>, label string, n string, x int"


def _query(table, spark, rows, tmp_path):
    table([(i, v, "l", "n", 1) for i, v in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    return W.op11_query(spark, str(tmp_path)).collect()


def test_edges(table, spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.0, 1.0, 2.0]), (2, [1.0, 0.5, 2.0]), (2, [1.0, 0.5, 2.0]), (None, [3.0, -1.0, 2.0]), (4, [0.25, 7.0, 2.0])]
    bad = [(5, None), (6, []), (7, [1.0, None, 2.0]), (8, [nan, 1.0, 2.0]), (9, [inf, 1.0, 2.0]), (10, [1.0, 2.0]), (11, [3e38, 1.0, 2.0])]
    rows = _query(table, spark, good + bad, tmp_path)
    # the third dimension is constant: two components
    assert sorted(((r.vec_id, r.component) for r in rows), key=str) == sorted([(i, c) for i, _ in good for c in (1, 2)], key=str)
    assert {r.n for r in rows} == {4} and max(r.identity_error for r in rows) < 1e-9
    twice = [r.whitened for r in rows if r.vec_id == 2 and r.component == 1]
    assert len(twice) == 2 and twice[0] == pytest.approx(twice[1], abs=1e-12)
    assert _query(table, spark, [], tmp_path / "none") == []
    assert _query(table, spark, bad[:5], tmp_path / "bad") == []
    assert _query(table, spark, good[1:3], tmp_path / "same") == []


def test_a_common_offset_costs_no_digits(table):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 50, (200, 5))
    near = W.fitted(W.usable(table([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<long>"), "i", "v"))[1]
    far = W.fitted(W.usable(table([(i, (v + (1 << 44)).tolist()) for i, v in enumerate(x)], "i long, v array<long>"), "i", "v"))[1]
    assert np.allclose(near.values, far.values, rtol=1e-12)
    big = W.project(table([(1, [1 << 44, 0]), (2, [1, 2])], "id long, x array<long>"), W.Model(1 << 30, [0, 0], np.ones(1), np.ones((2, 1)), 1.0)).collect()
    assert {r.id: r.deviation for r in big} == {1: None, 2: 5 << 60}
