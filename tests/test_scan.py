"""W1, W2, W5, W6 over ranges against plain loops, with one run that has all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from grainmill.operators import scan


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Ranges of these small tables stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows_of(runs, seed):
    r = random.Random(seed)
    return [(k, i, r.choice([None, float("nan"), *[r.uniform(-5, 5)] * 6]) if seed else r.uniform(-5, 5)) for k, n in runs for i in range(n)]


def ran(spark, rows, inputs, s, down=False):
    df = spark.createDataFrame(rows, "run string, at long, v double").repartition(6)
    out = scan.scanned(df, "run", F.col("at"), inputs, s, down).collect()
    assert len(out) == len(rows)
    return {(r.run, r["at"]): tuple(r)[3:] for r in out}


RUNS = [[("a", 3000)], [("a", 700), (None, 40), ("c", 1), ("d", 300)], []]


@pytest.mark.parametrize("runs", RUNS)
def test_advantages(spark, runs):
    rows = rows_of(runs, 0)
    got = ran(spark, rows, [F.col("v"), F.col("v") * 0.5], scan.advantages_scan(), down=True)
    for k, n in runs:
        own, a, later = [v for q, _, v in rows if q == k], 0.0, 0.0
        for i in reversed(range(n)):
            a = own[i] + 0.99 * later - own[i] * 0.5 + 0.99 * 0.95 * a
            later = own[i] * 0.5
            assert got[k, i][0] == pytest.approx(a, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("runs", RUNS)
def test_moments(spark, runs):
    rows = [(k, i, None if v is None or math.isnan(v) else v) for k, i, v in rows_of(runs, 3)]
    got, seen = ran(spark, rows, [F.col("v")], scan.MOMENTS), {}
    for k, i, v in rows:
        own = seen.setdefault(k, [])
        own += [] if v is None else [v]
        n, mean, dev = got[k, i]
        assert n == len(own)
        if own:
            m = math.fsum(own) / n
            assert mean == pytest.approx(m, abs=1e-9) and dev == pytest.approx(math.sqrt(math.fsum((x - m) ** 2 for x in own) / n), abs=1e-6)


@pytest.mark.parametrize("runs", RUNS)
def test_moving_average(spark, runs):
    rows = rows_of(runs, 5)
    got, seen = ran(spark, rows, [F.col("v")], scan.moving_average_scan(4)), {}
    for k, i, v in rows:
        own, last = seen.get(k, ([], 0.0))
        own = [*own, v]
        if v is not None and math.isfinite(v):
            good = [x for x in own[-4:] if x is not None and math.isfinite(x)]
            last = sum(good) / len(good)
        seen[k] = own, last
        assert got[k, i][0] == pytest.approx(last, abs=1e-9)


def test_least_and_sum_and_count(spark):
    rows = rows_of([("a", 500), ("b", 20)], 0)
    got, place = ran(spark, rows, [F.col("v"), F.col("at")], scan.LEAST_AND_SUM), ran(spark, rows, [], scan.COUNT)
    for k in "ab":
        own = [(i, v) for q, i, v in rows if q == k]
        for j, (i, _) in enumerate(own):
            assert got[k, i] == (min(v for _, v in own[: j + 1]), sum(x for x, _ in own[: j + 1])) and place[k, i] == (j + 1,)


def test_ranges_share_a_run(spark):
    """The rows of the only run are in several tasks."""
    df = spark.range(2000).select(F.lit("a").alias("run"), "id").repartition(4)
    out = scan.scanned(df, "run", F.col("id"), [], scan.COUNT)
    assert out.withColumn("p", F.spark_partition_id()).groupBy("p").count().count() > 1
    assert out.agg(F.max("step"), F.countDistinct("step")).first()[:] == (2000, 2000)
