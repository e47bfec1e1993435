"""op6 against its oracle and against exact containment in Python; no Python nodes in the plan."""

import random

from grainmill.llm import op6_licenses as op
from tests.oracle import duck, rows_of_duck, rows_of_spark

SF = "/root/testdata/sf0.001"


def test_oracle(spark):
    assert rows_of_spark(op.op6_licenses(spark, SF)) == rows_of_duck(duck(SF), op.ORACLES["op6_licenses"])


def test_native(spark):
    plan = op.op6_licenses(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_bands_guarantee():
    assert op.bands_for(8, 1) >= 100 and op.step_of(12) == 16


def test_edited_templates(spark):
    rng = random.Random(0)
    rows, want = [], set()
    filler = [f"f{i}" for i in range(50)]
    for d in range(60):
        name = rng.choice(sorted(op.TEMPLATES))
        w = op.plain_words(op.TEMPLATES[name])
        for _ in range(rng.choice([0, 0, 1, 3])):
            w[rng.randrange(len(w))] = rng.choice(filler)
        text = rng.choices(filler, k=rng.randint(0, 150)) + w + rng.choices(filler, k=rng.randint(0, 150))
        rows.append((d, " ".join(text)))
        sh = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
        for n, t in op.TEMPLATES.items():
            own = sh(op.plain_words(t))
            if len(own & sh(text)) >= 0.8 * len(own):
                want.add((d, n))
    got = {(r.doc_id, r.license) for r in op.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_cases(spark):
    long = "word " * 30_000 + op.TEMPLATES["mit_notice"] + " word" * 30_000
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "MIT License", "c"), (4, long, "d"), (4, long, "d")], "doc_id long, text string, license string")
    got = op.scan(df).collect()
    assert [(r.doc_id, r.license, r.containment) for r in got] == [(4, "mit_notice", 1.0)]
    assert op.scan(df.limit(0)).count() == 0
