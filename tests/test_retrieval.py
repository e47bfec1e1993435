"""Block bounds against the plain formula, and the share of postings that they leave."""

import math
import random
import re
from collections import Counter

import pytest

from grainmill.operators import retrieval as R


def plain(docs, queries, k):
    held = [(i, re.findall(r"[a-z0-9']+", (t or "").lower())) for i, t in docs if t is not None]
    n, mean = len(held), sum(len(t) for _, t in held) / max(1, len(held))
    df = Counter(w for _, t in held for w in set(t))
    out = []
    for q, text in queries:
        rows = []
        for i, t in held:
            tf, s = Counter(t), 0.0
            for w in re.findall(r"[a-z0-9']+", text.lower()):
                if tf[w]:
                    s += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / mean))
            if s > 0:
                rows.append((-round(s, 6), i))
        out += [(q, i, -s, rank) for rank, (s, i) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("few", [100_000, 2])
def test_bm25(spark, monkeypatch, few):
    monkeypatch.setattr(R, "BROADCAST_TERMS", few)
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(["the"] * r.randint(0, 9) + r.choices(words, weights=[1 / (j + 1) for j in range(300)], k=r.randint(1, 40)))) for i in range(900)] + [(2000, ""), (2001, None)]
    queries = [(0, "the w250 w3 w3"), (1, "w290"), (2, "nothing here"), (3, "the the"), (4, "w1 w2 w299 w200")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    best, share = R.best_documents(d, q, 5, block=8)
    assert sorted((x.query_id, x.doc_id, x.score, x["rank"]) for x in best.collect()) == plain([x for x in docs if x[1] is not None], queries, 5)
    read = {x.query_id: x["read"] / x.postings for x in share.collect()}
    assert read[0] < 0.5 and all(0 < v <= 1 for v in read.values())
