"""Texts are read once, and sets of two blocks meet by as few of their rarest terms as their sizes allow."""

import random

import numpy as np
import pytest

from grainmill.operators import retrieval as R
from tests.test_alike import expected


def test_texts_are_read_once(spark, monkeypatch):
    cuts, own = [], R.cut
    monkeypatch.setattr(R, "cut", lambda df: cuts.append(df._jdf.queryExecution().optimizedPlan().toString()) or own(df))
    R.alike(spark.createDataFrame([(1, "red green blue"), (2, "red green blue sky")], "doc_id long, text string")).collect()
    assert sum("lower(" in x for x in cuts) == 1


@pytest.mark.parametrize("sizes", [(1, 8), (5, 60), (60, 400)])
def test_rare_terms_lose_no_pair(sizes):
    """Against brute force, on sets of frequent terms, many of them just alike."""
    r = random.Random(sum(sizes))
    base = [r.sample(range(3 * sizes[1]), sizes[1]) for _ in range(6)]
    sets = sorted((sorted(set(r.sample(r.choice(base), r.randint(*sizes)) + [r.randrange(5 * sizes[1]) for _ in range(r.randint(0, sizes[1] // 4))])) for _ in range(160)), key=len)
    ids = r.sample(range(1000), len(sets))

    def of(lo, hi):
        n = np.array([len(s) for s in sets[lo:hi]])
        return R._Sets(np.array(ids[lo:hi]), n, np.concatenate(([0], np.cumsum(n))), np.concatenate(sets[lo:hi]))

    got = {}
    for x, y in ((of(0, 70), of(70, 160)), (of(70, 160), of(0, 70)), (of(0, 70),) * 2, (of(70, 160),) * 2):
        for a, b in R._least_alike(x, y):
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                got[i] = min(j, got.get(i, j))
    want = expected([(i, " ".join(map(str, s))) for i, s in zip(ids, sets, strict=True)])
    assert got == {a: b for a, b in want.items() if a != b} and got


def test_unlike_sizes_meet_by_fewer_terms():
    """Sets of one size meet by their rarest third, and ones twice as large by few of the smaller one's."""
    n = np.array([300])
    assert (n - R._dropped(n, 300)[0])[0] <= 110 and (n - R._dropped(n, 600)[0])[0] <= 10
