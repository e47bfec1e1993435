"""op10 against brute force, with ties, odd vectors and small blocks."""

import numpy as np
import pytest

from grainmill.llm import op10_topk as op
from grainmill.llm.vectors import usable


def brute(ids, x, queries, k):
    out = []
    for q in queries:
        s = sorted((-int(x[ids.index(q)] @ x[i]), c) for i, c in enumerate(ids) if c != q)[:k]
        out += [(q, r + 1, c, -v) for r, (v, c) in enumerate(s)]
    return out


def test_bounds_hold_and_tighten():
    r = np.random.default_rng(0)
    q, x = r.normal(size=(50, 37)), r.normal(size=(60, 37))
    basis = op.basis_of(x, 37)
    assert np.allclose(basis @ basis.T, np.eye(37))
    a, b = op.Rows(np.arange(50), q, basis), op.Rows(np.arange(100, 160), x, basis)
    gaps = []
    for i, m in enumerate(op.singles(37)):
        gap = a.y[:, :m] @ b.y[:, :m].T + a.rest[i] @ b.rest[i].T - q @ x.T
        assert (gap >= -1e-9).all()
        gaps.append(gap.mean())
    assert gaps == sorted(gaps, reverse=True)


def test_share_of_pairs_that_are_scored():
    """Of vectors near a few directions the bounds leave few pairs; none of the best is lost."""
    r = np.random.default_rng(3)
    x = np.floor(64 * (r.normal(size=(3000, 8)) @ r.normal(size=(8, 64)) + 0.05 * r.normal(size=(3000, 64))))
    basis, ids = op.basis_of(x[:500], 64), np.arange(3000)
    own = op.Rows(ids[::20], x[::20], basis)
    best = op.Best(own, 10)
    for i in range(0, 3000, 500):
        best.visit(op.Rows(ids[i : i + 500], x[i : i + 500], basis))
    pairs = best.pairs
    assert pairs[0] == 150 * 2999 and (np.diff(pairs) <= 0).all() and pairs[-1] < 0.05 * pairs[0]
    score = x[::20] @ x.T
    score[np.arange(150), ids[::20]] = -np.inf
    want = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :10]
    assert (best.id.reshape(150, 10) == want).all() and (best.score.reshape(150, 10) == np.take_along_axis(score, want, 1)).all()


def test_rows_held_and_emitted_with_copies():
    """A block keeps k rows a query for all candidate blocks, however many copies tie."""
    x = np.tile(np.array([[3.0, 1.0, -2.0, 5.0]]), (400, 1))
    own = op.Rows(np.arange(0, 400, 20), x[::20], np.eye(4))
    best = op.Best(own, 7)
    for i in range(0, 400, 10):
        best.visit(op.Rows(np.arange(i, i + 10), x[:10], np.eye(4)))
        assert (np.bincount(best.row) <= 7).all()
    out = best.batch().to_pydict()
    assert len(out["query_id"]) == 140
    assert out["vec_id"][:14] == [1, 2, 3, 4, 5, 6, 7, 0, 1, 2, 3, 4, 5, 6]


def test_partitions_change_nothing(spark):
    r = np.random.default_rng(4)
    x = r.integers(-9, 10, (600, 16))
    x[100:300] = x[3]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute([*range(600)], x, [*range(0, 600, 20)], 7)
    for parts in (1, 40):
        own = df.repartition(parts)
        assert sorted(tuple(map(int, t)) for t in op.search(own.filter("vec_id % 20 = 0"), own, 7, 64, 10, 150, 100).collect()) == sorted(want)


@pytest.mark.parametrize("rows", [3, 16, 500])
def test_against_brute_force(spark, rows):
    r = np.random.default_rng(1)
    x = r.integers(-3, 4, (180, 12))
    x[100:140] = x[3]  # ties
    ids = list(range(0, 360, 2))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = sorted(tuple(map(int, t)) for t in op.search(df.filter("vec_id % 20 = 0"), df, 7, rows, 4, 50, 30).collect())
    assert got == sorted(brute(ids, x, [i for i in ids if i % 20 == 0], 7))


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, None, 1), (2, [nan, 1.0], 1), (3, [inf, 1.0], 1), (4, [None, 1.0], 1), (5, [0.0, 0.0], 1), (6, [0.5, -0.5], 2), (6, [0.5, -0.5], 3), (7, [], 1), (20, [-1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    v = op.quantised(usable(df, zero=True))
    got = sorted((t.query_id, t["rank"], t.vec_id, int(t.score)) for t in op.search(v.filter("vec_id % 20 = 0"), v, 20).collect())
    assert got == [(0, 1, 6, 2048), (0, 2, 5, 0), (0, 3, 20, -4096), (20, 1, 5, 0), (20, 2, 0, -4096), (20, 3, 6, -6144)]
    assert op.search(v.limit(0), v.limit(0), 20).count() == 0
