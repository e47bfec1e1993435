"""R6 by ranges of the ring: the same neighbours as by places, and texts move once."""

import pytest

from grainmill.operators import mixing as M


@pytest.mark.parametrize(("n", "k"), [(1, 3), (3, 3), (40, 3), (300, 3), (300, 1)])
def test_ranges_give_what_places_give(spark, monkeypatch, n, k):
    monkeypatch.setattr(M, "RANGE_ROWS", 16)
    facts = spark.createDataFrame([(i * 7, None if i % 50 == 9 else f"fact {i}") for i in range(n)], "id long, fact string")
    rows = lambda x: sorted((r.id, r.fact, r.distractors) for r in x.collect())
    got = M.with_distractors(facts, k)
    assert rows(got) == rows(M._with_distractors_of_few(facts, k, 3))
    if n == 300:
        assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
