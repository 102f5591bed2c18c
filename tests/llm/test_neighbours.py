import numpy as np
import pytest

from driftspark.llm import neighbours as N


def brute(rows, queries, k=5):
    fine = {(i, tuple(v)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    out = []
    for q, x in sorted((i, v) for i, v in fine if i in queries):
        x = np.array(x, dtype=np.float64)
        c = sorted((-float((np.array(v) * x).sum() / (np.sqrt((np.array(v) ** 2).sum()) * np.sqrt((x * x).sum()))), i) for i, v in fine if i != q and len(v) == len(x))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(c[:k])]
    return out


@pytest.mark.parametrize("blocks", [(2048, 8192), (7, 11)])
def test_against_brute_force(table, monkeypatch, blocks):
    monkeypatch.setattr(N, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(N, "CANDIDATE_BLOCK", blocks[1])
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [rows[7], (400, None), (401, []), (402, [0.0] * 16), (450, [None] + [1.0] * 15), (500, [float("nan")] * 16),
             (550, [float("inf")] + [1.0] * 15), (None, rows[3][1]), (600, [1.0, 2.0]), (650, [1e-30] * 16), (651, [1e30] * 16)]
    frame = table(rows, "vec_id long, embedding array<float>")
    got = N.nearest(frame, frame.where("vec_id % 50 = 0")).collect()
    rows = [(i, v and [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    want = brute(rows, {i for i, _ in rows if i is not None and i % 50 == 0})
    assert [(a[0], a[1], a[2]) for a in sorted(map(tuple, got))] == [w[:3] for w in want]
    assert max(abs(a[3] - w[3]) for a, w in zip(sorted(map(tuple, got)), want)) < 1e-12


def test_few_rows(table):
    frame = table([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in N.nearest(frame, frame.where("vec_id = 0")).collect()] == [(0, 1, 1, 0.0)]
    empty = table([], "vec_id long, embedding array<float>")
    assert N.nearest(empty, empty).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(50, 33)) ** 3, rng.normal(size=(60, 33)) ** 3
    qc, qs, ql, qr = N.quantised(a)
    rc, rs, rl, rr = N.quantised(b)
    near = (qc.astype(float) @ rc.astype(float).T) * qs[:, None] * rs[None, :]
    true = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None, :]
    assert (np.abs(near - true) <= ql[:, None] * rr[None, :] + qr[:, None] * (rl + rr)[None, :] + 1e-9).all()
