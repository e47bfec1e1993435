"""T4, T6, T18 on inputs that make backtracking expressions slow, and against those expressions on short ones."""

import random
import re
import time

from pyspark.sql import functions as F

from grainmill.functions import text as X
from grainmill.operators import records

RULES = (r"(?s)Q:\s*(.+?)\s*A:\s*(.+?)(?=Q:|$)", r"(?si)(?:User|Human):\s*(.+?)\s*(?:AI|Assistant):\s*(.+?)(?=(?:User|Human):|$)")


def test_turns_like_the_expressions():
    r = random.Random(1)
    for rule, marks, parts in zip(RULES, records.QA_MARKS, (["Q:", "A:", " ", "\n", "x", "y z", "Q", "A", ":"], ["User:", "human:", "AI:", "assistant:", " ", "\n\n", "x", "ai", ":"]), strict=True):
        for _ in range(20_000):
            t = "".join(r.choices(parts, k=r.randint(0, 9))).strip()
            assert records.turns(t, *marks) == [(a.strip(), b.strip()) for a, b in re.findall(rule, t)], t


def test_headings_like_the_expression(spark):
    r = random.Random(2)
    texts = ["".join(r.choices(["=", "==", " ", "\n", "a", "b c", "\t", "é", "\u2028"], k=r.randint(0, 12))) for _ in range(20_000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_replace("t", X.HEADING, "$1").alias("a"), F.regexp_replace("t", X.PLAIN_HEADING, "$1").alias("b"))
    assert df.filter("a <> b").collect() == []


def test_long_inputs(spark):
    started = time.time()
    for t in ("Q:" + " " * 1_000_000 + "x", "Q:" * 500_000, "Q: a" + " " * 1_000_000 + "b", "User:" * 200_000, "Q: A:" * 200_000):
        records.sequences(t)
    assert time.time() - started < 10
    texts = ["=" * 1_000_000 + "x", "= a" + "=" * 1_000_000 + "x", "= a" + " " * 1_000_000 + "x", "= " * 500_000 + "x", "=\n" * 300_000 + "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").cache()
    df.count()
    started = time.time()
    df.select(F.sum(F.length(F.regexp_replace("t", X.HEADING, "$1")))).collect()
    assert time.time() - started < 10
