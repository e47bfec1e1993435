"""op4: targets against a plain water-filling loop, takes near targets, positions against the schedule."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.llm import op4_mix as op

SF = "/root/testdata/sf0.01"


def fill(sizes, weights, budget=1.5, passes=2.0):
    """Shares by weight; cap; share the excess again among those below their cap."""
    total, target, open_ = budget * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while True:
        rest = total - sum(target[i] for i in range(len(sizes)) if i not in open_)
        w = sum(weights[i] for i in open_)
        for i in open_:
            target[i] = rest * weights[i] / w
        over = {i for i in open_ if target[i] > passes * sizes[i]}
        if not over:
            return target
        for i in over:
            target[i] = passes * sizes[i]
        open_ -= over


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    docs["size"] = [len(t.encode().split()) for t in docs.text]
    rows = op.op4_mix(spark, SF).toPandas()
    assert len(rows) == len(docs) and (rows.merge(docs, on="doc_id").eval("size_x == size_y")).all()
    by = docs.groupby("source")["size"].sum().sort_index()
    aim = dict(zip(by.index, fill(by.tolist(), [(3, 1, 2)[i % 3] for i in range(len(by))]), strict=True))
    own = rows.merge(docs[["doc_id", "source"]], on="doc_id")
    assert np.allclose(own.target, own.source.map(aim)) and (own.source_size == own.source.map(by)).all()
    assert (own.taken <= 2 * own["size"]).all()
    taken = own.groupby("source").taken.sum()
    assert ((taken - taken.index.map(aim)).abs() <= docs.groupby("source")["size"].max()).all()
    again = op.op4_mix(spark, SF).toPandas()
    assert rows.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_positions_follow_the_schedule(spark):
    s = ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5))
    u = [i / 100 for i in range(101)]
    got = [r.t for r in spark.createDataFrame([(x,) for x in u], "u double").select(op.inverse_demand(F.col("u"), s).alias("t")).collect()]
    fine = np.linspace(0, 1, 200_001)
    area = np.concatenate([[0], np.cumsum(np.interp((fine[1:] + fine[:-1]) / 2, *zip(*s, strict=True)) * np.diff(fine))])
    assert np.allclose(got, np.interp(u, area / area[-1], fine), atol=1e-4)


def test_mixed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = op.placed(docs.select("doc_id", "source", "text")).filter("copies > 0").select("doc_id", "copies").toPandas()
    out = op.mixed(docs)
    assert out.columns == docs.columns
    got = out.groupBy("doc_id").count().toPandas()
    assert dict(zip(plan.doc_id, plan.copies, strict=True)) == dict(zip(got.doc_id, got["count"], strict=True))


@pytest.mark.parametrize("rows", [[], [(1, None, None, "x")], [(1, "a b", None, "x"), (1, "a b", None, "x"), (2, "", "s", "y"), (3, "w " * 9000, "é", "z"), (4, None, "s", "q")]])
def test_cases(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, Target string")
    got = op.placed(df).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r["size"] for r in got)
    out = op.mixed(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)


def test_clashing_columns(spark):
    names = ["_h", "_b", "_in", "_before", "_passes", "_s", "_k", "_middle", "_copy", "place", "copies", "position", "taken", "target", "source_size", "size", "kept", "k0", "_sum"]
    df = spark.createDataFrame([(i, "a b c", "s", *range(len(names))) for i in range(6)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    out = op.mixed(df)
    assert out.columns == df.columns
    assert {tuple(r)[3:] for r in out.collect()} == {tuple(range(len(names)))} and {"taken", "position"} <= set(op.placed(df).columns)
