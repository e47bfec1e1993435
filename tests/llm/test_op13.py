"""op13: the query against its SQL, the operator against a plain loop, exact arithmetic, edge cases."""

import random
import re
from collections import Counter

import pytest

from grainmill.llm import op13_collocations as op
from tests.oracle import duck, rows_of_duck, rows_of_spark

SF = "/root/testdata/sf0.001"


def plain(docs, m):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, m.longest + 1) for i in range(len(w) - k + 1))
    cands = {p: a for p, a in f.items() if a >= m.support and len(p) > 2}
    out = []
    for (lang, *p), a in cands.items():
        inside = lambda q: any(list(q[i : i + len(p)]) == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
        if any(q[0] == lang and len(q) > len(p) + 1 and 100 * b >= m.cover * a and inside(q[1:]) for q, b in cands.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, *p[:k]] * f[lang, *p[k:]]), k) for k in range(1, len(p))]
        s, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, *p[:k]], f[lang, *p[k:]], n[lang], s))
    rows = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        rows += [(lang, i + 1, *r[1:]) for i, r in enumerate(own[: m.top])]
    return sorted(rows)


def run(spark, docs, m):
    return sorted(tuple(r) for r in op.collocations(spark.createDataFrame(docs, "text string, lang string"), m).collect())


def test_oracle(spark):
    assert rows_of_spark(op.op13_collocations(spark, "/root/testdata/sf0.01")) == rows_of_duck(duck("/root/testdata/sf0.01"), op.ORACLES["op13_collocations"])


@pytest.mark.parametrize("mining", [op.Mining(support=4, bits=10), op.Mining(support=3, cover=70, top=7, bits=18, longest=4), op.Mining(support=300, bits=6, longest=3)])
def test_against_loop(spark, mining, monkeypatch):
    monkeypatch.setattr(op, "PART", 64)
    monkeypatch.setattr(op, "HELD", 50)
    r = random.Random(1)
    words = ["The", "the", "éa", "b", "C-d", "x y", "ß", "q1"]
    docs = [("".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None, ""])) for _ in range(400 if mining.support < 100 else 2000)]
    docs += [("New york new york CITY hall. " * 5, "en")] * 2
    got = run(spark, docs, mining)
    assert got == plain(docs, mining) and got


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_017
    one = spark.createDataFrame([("en", "a", big), ("en", "b", 7 * big + 1)], "lang string, phrase string, f long")
    two = spark.createDataFrame([("en", "a b", big - 5)], "lang string, phrase string, f long")
    n = 9_000_000_000_000_011
    (row,) = op.scored([one, two], spark.createDataFrame([("en", n)], "lang string, n long")).collect()
    assert row.score == 1000 * (big - 5) * n // (big * (7 * big + 1))


@pytest.mark.parametrize("docs", [[], [(None, None), ("", "en"), (" \t.", "en")], [("a b", "en")] * 3, [("a b " * 50_000, "en")], [("." * 10 + "a\x00b \x7f c", None)] * 5])
def test_cases(spark, docs):
    m = op.Mining(support=4, bits=8)
    assert run(spark, docs, m) == plain(docs, m)


def test_other_columns_are_not_read(spark):
    docs = spark.createDataFrame([("x y", "en", 1, 2, 3)] * 5, "text string, lang string, f int, phrase int, part int")
    (row,) = op.collocations(docs, op.Mining(support=5, bits=8)).collect()
    assert (row.phrase, row.a, row.n, row.score) == ("x y", 5, 10, 2000)
