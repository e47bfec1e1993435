"""op2 against all pairs, with tiles of every size, and the components' rounds."""

import random
import re
from collections import defaultdict

import pytest

from grainmill.llm import op2_jaccard as op
from grainmill.operators.graph import components


def brute(rows, n=4, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], d)
    return sorted((d, len(sets[i]), least[find(i)], links[i]) for i, (d, _) in enumerate(rows))


def near_copies(rng, count):
    words = [f"w{i}" for i in range(400)]
    rows = []
    for b in range(6):
        base = rng.choices(words, k=rng.choice([3, 5, 40, 120, 130]))
        for _ in range(count):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append(" ".join(t))
    rows += [" ".join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(40)]
    rows += [None, "", " \n", "One two", "one TWO", "É x", "é x"]
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,block_rows,part_rows", [(1, 2048, 512), (2, 3, 4), (3, 1, 10)])
def test_against_all_pairs(spark, seed, block_rows, part_rows):
    rows = near_copies(random.Random(seed), 25)
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, cls string")
    got = op.join(df, block_rows=block_rows, part_rows=part_rows).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = op.op2_jaccard(spark, d).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_cases(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, None), (2, None), (9, "x " * 30_000)], "doc_id long, text string")
    got = sorted(map(tuple, op.join(df).select("doc_id", "n_shingles", "component_id", "n_links").collect()))
    assert got == [(1, 2, 1, 1), (1, 2, 1, 1), (2, 0, 2, 0), (2, 0, 2, 0), (9, 1, 9, 0)]
    assert op.join(df.limit(0)).count() == 0


def test_sets_that_share_a_name_are_told_apart(spark):
    df = spark.createDataFrame([(1, 7, 1), (2, 7, 2), (3, 7, 1), (4, 8, 1), (5, None, None)], "doc_id long, cls long, check long")
    got = {r.doc_id: r.cls for r in op.told_apart(df).collect()}
    assert got[1] == got[3] != got[2] and got[4] == 8 and got[5] is None


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(300) if i % 60 != 59] + [(1000, 1000 + i) for i in range(1, 80)]
    rng.shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()))
    assert got == {**{i: i // 60 * 60 for i in range(301) if i != 300}, **({300: 300} if 300 in got else {}), **{1000 + i: 1000 for i in range(80)}}
