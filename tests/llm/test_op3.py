"""op3: recall against brute force, exact scores, copies, and odd inputs."""

import numpy as np

from grainmill.llm import op3_ann as op
from pyspark.sql import functions as F


def recall(vectors, got, k):
    ids, x = vectors
    by = {}
    for q, r, v, s in got:
        by.setdefault(q, []).append((r, v, s))
    hit = total = 0
    for i, q in enumerate(ids):
        if q % 20:
            continue
        s = x @ x[i]
        s[i] = -np.inf
        order = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        own = sorted(by[q])
        assert [r for r, _, _ in own] == list(range(1, len(order) + 1))
        place = {v: j for j, v in enumerate(ids)}
        assert all(abs(z - x[i] @ x[place[v]]) < 1e-12 for _, v, z in own)
        assert own == sorted(own, key=lambda t: (-t[2], t[1]))
        hit += len({v for _, v, _ in own} & set(ids[order]))
        total += len(order)
    return hit / total


def test_recall(spark):
    d = "/root/testdata/sf0.1"
    t = spark.read.parquet(f"{d}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.stack(t.embedding).astype(float)
    got = list(map(tuple, op.op3_ann(spark, d).collect()))
    assert recall((t.vec_id.to_numpy(), x), got, 20) >= 0.95


def test_descent_and_copies(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(700, 16)) * r.uniform(0.5, 2, (700, 1))
    x[300:420] = x[7]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    p = op.Params(neighbours=20, reverse=12, block=64, projections=2, rounds=4)
    got = list(map(tuple, op.search(df, F.col("vec_id") % 20 == 0, 10, p).collect()))
    assert recall((np.arange(700), x), got, 10) >= 0.9


def test_wide_vectors_and_one_huge_component(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 768))
    x[17] *= 1e12
    x[40:200:2] = x[3]  # a vector that a quarter of the rows have
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    p = op.Params(neighbours=20, reverse=12, block=64, projections=4, rounds=4)
    got = [t for t in map(tuple, op.search(df, F.col("vec_id") % 20 == 0, 10, p).collect())]
    by = {}
    for q, rank, v, s in got:
        by.setdefault(q, {})[rank] = (v, s)
    hit = 0
    for q in range(0, 300, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(300), -s))[:10]
        assert sorted(by[q]) == [*range(1, 11)] and all(np.isclose(z, x[q] @ x[v]) for v, z in by[q].values())
        hit += len({v for v, _ in by[q].values()} & set(want.tolist()))
    assert hit >= 0.9 * 150


def test_codes_keep_their_scale(spark):
    x = np.array([[1e300, 0.0], [3.0, -4.0], [1e-3, 5e-4]])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "node long, embedding array<double>")
    got = op.codes(op.packed(df.filter("node > 0")).orderBy("node").toArrow()["code"].combine_chunks())
    assert np.allclose(got / got[0, 1] * -4, x[1:], rtol=0.01)
    assert np.isfinite(op.codes(op.packed(df).toArrow()["code"].combine_chunks())).all()


def test_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, None, 1), (2, [nan, 1.0], 1), (3, [0.0, 0.0], 1), (4, [0.5, 0.5], 1), (4, [0.5, 0.5], 2), (5, [0.5, 0.5], 1), (20, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int")
    got = sorted(map(tuple, op.search(op.usable(df, zero=False), F.col("vec_id") % 20 == 0, 20).collect()))
    assert got == [(0, 1, 4, 0.5), (0, 2, 5, 0.5)]
    assert op.search(op.usable(df, zero=False).limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0
