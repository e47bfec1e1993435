"""op11: the query against its SQL, the operator against a plain loop, and edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from grainmill.llm import op11_importance as op
from tests.oracle import duck, rows_of_duck, rows_of_spark

SF = "/root/testdata/sf0.001"


def plain(docs, target, draw):
    """[(doc_id, n_features, weight, score, rank)] by loops over whole texts."""

    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        return len(words), [" ".join(words[i : i + k]) for k in range(1, draw.runs + 1) for i in range(len(words) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % draw.buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in docs], target))
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + draw.buckets) / ((s[b] + 1) * (m + draw.buckets))))
    rows = []
    for i, x in docs:
        words, own = features(x)
        weight = sum(gain(bucket(f)) for f in own)
        h = int(hashlib.sha256(f"{draw.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    fit = sorted((r for r in rows if r[5] >= draw.least_words), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1]))
    for place, r in enumerate(fit[: len(fit) * draw.percent // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def run(spark, docs, target, draw):
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string")
    got = op.resample(d, t, draw).select("doc_id", "n_features", "weight", "score", "rank").collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_oracle(spark):
    assert rows_of_spark(op.op11_importance(spark, SF)) == rows_of_duck(duck(SF), op.ORACLES["op11_importance"])


@pytest.mark.parametrize("runs", [1, 3])
def test_against_loop(spark, runs, monkeypatch):
    monkeypatch.setattr(op, "PIECE", 40)
    docs = [(i, " ".join(f"W{(i * j) % 17}x é{j % 5}" for j in range(i % 23))) for i in range(150)]
    target = ["w3x É1 w4x", "w5x é2 w5x é2", None]
    draw = op.Draw(runs=runs, buckets=97, least_words=6, percent=30, seed=5)
    assert run(spark, docs, target, draw) == plain(docs, target, draw)


@pytest.mark.parametrize("docs", [[], [(None, None), (1, ""), (1, "a b"), (1, "a b"), (2, "a " * 300_000), (None, "a b c"), (3, "--"), (3, "A,B")]])
@pytest.mark.parametrize("target", [[], [None, "a b"]])
def test_cases(spark, docs, target):
    draw = op.Draw(buckets=50, least_words=2, percent=80)
    assert run(spark, docs, target, draw) == plain(docs, target, draw)


def test_ties_take_the_smaller_id(spark):
    rows = spark.createDataFrame([(i, 30, 30, i % 3) for i in range(90)], "doc_id long, n_words long, n_features long, score long")
    got = op.ranked(rows, op.Draw(percent=50)).filter("rank is not null").orderBy("rank").select("doc_id").collect()
    assert [r.doc_id for r in got] == sorted(range(90), key=lambda i: (-(i % 3), i))[:45]


def test_clashing_columns(spark):
    names = ["_n", "_down", "_before", "_place", "k0", "kept", "Score", "place", "_v", "_part", "n", "b"]
    docs = spark.createDataFrame([(i, "a b c", *range(len(names))) for i in range(5)], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    out = op.resample(docs, docs.select(F.lit("b").alias("text")), op.Draw(least_words=1, percent=100))
    assert out.columns == ["doc_id", *[n for n in names if n != "Score"], "n_words", "n_features", "weight", "score", "rank"]
    assert all(r["_place"] == 3 and r["place"] == 7 for r in out.collect()) and {r["rank"] for r in out.collect()} == {1, 2, 3, 4, 5}
