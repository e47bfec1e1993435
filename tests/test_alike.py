"""J9 by blocks of sets against brute force: pairs stay inside tasks."""

import random

import numpy as np
import pytest

from grainmill.operators import retrieval as R


def expected(texts):
    sets = {i: frozenset(t.split()) for i, t in texts}
    return {a: min([b for b, t in sets.items() if 3 * len(s & t) >= len(s) + len(t)], default=a) for a, s in sets.items() if s}


@pytest.mark.parametrize(("weight", "cells"), [(900, 64), (1 << 23, 1 << 19)])
def test_blocks_against_brute_force(spark, monkeypatch, weight, cells):
    monkeypatch.setattr(R, "BLOCK_WEIGHT", weight)
    monkeypatch.setattr(R, "CELLS", cells)
    r = random.Random(3)
    bases = [[f"w{r.randrange(60)}" for _ in range(r.choice([1, 3, 8, 30]))] for _ in range(25)]
    texts = []
    for i in r.sample(range(1000), 120):
        own = [w if r.random() < 0.85 else f"w{r.randrange(60)}" for w in r.choice(bases)]
        texts.append((i, " ".join(own + [f"only{i}"] * (r.random() < 0.2))))
    texts.append((2000, ""))
    got = {x.doc_id: x.other for x in R.alike(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == expected(texts) and any(a != b for a, b in got.items())

def test_a_task_gives_one_row_a_set():
    """Of n near copies no task writes n * n pairs."""
    n = 200
    terms = np.concatenate([np.arange(40), [1000]] * n).astype(np.int64)
    terms[40::41] += np.arange(n)
    x = R._Sets(np.arange(n)[::-1].copy(), np.full(n, 41), np.arange(n + 1) * 41, terms)
    (a, b), = R._least_alike(x, x)
    assert len(a) == n - 1 and not b.any()
