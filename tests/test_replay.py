"""Replay against a plain simulation, its draw against the distribution, pairs by rotation."""

import random

import pytest
from pyspark.sql import functions as F

from grainmill.operators import mixing, replay
from grainmill.operators.conversations import talks
from grainmill.streaming import stored
from grainmill.streaming.store import Store

ROWS = "id long, seq long, reward double, note string"


def weight(reward):
    return abs(reward if reward is not None and reward == reward else 0.0) + 1e-6


def after(state, batch, capacity):
    """The experiences after a batch, one row at a time."""
    new = {}
    for r in sorted(batch, key=lambda r: r[1]):
        new[r[0]] = r
    every = {**state, **new}
    return {r[0]: r for r in sorted(every.values(), key=lambda r: (-weight(r[2]), r[0]))[:capacity]}


@pytest.fixture
def batches():
    r = random.Random(5)
    value = lambda: r.choice([None, float("nan"), 0.0, *[r.uniform(-3, 3) for _ in range(20)]])
    return [[(r.randrange(60), 100 * b + k, value(), f"{b}.{k}") for k in range(r.choice([1, 12, 30]))] for b in range(6)]


def test_kept_and_merged(spark, batches):
    rows = list(after({}, sum(batches, []), 10**6).values())
    df = spark.createDataFrame(rows, ROWS)
    for capacity in (0, 1, 17, len(rows), 1000):
        assert {x.id for x in replay.kept(df, capacity).collect()} == set(after({}, rows, capacity))
    half = len(rows) // 2
    parts = replay.merged(replay.kept(spark.createDataFrame(rows[:half], ROWS), 9), spark.createDataFrame(rows[half:], ROWS), 9)
    assert {x.id for x in parts.collect()} == set(after({}, rows, 9))
    assert replay.kept(spark.createDataFrame([], ROWS), 5).isEmpty() and replay.sampled(spark.createDataFrame([], ROWS), 5, 1).isEmpty()


def test_stream_keeps_the_capacity_through_restarts(spark, tmp_path, batches):
    """Equal to the simulation after every batch, and when a batch runs again."""
    src, folder, state = str(tmp_path / "src"), str(tmp_path / "store"), {}
    for b in batches:
        spark.createDataFrame(b, ROWS).coalesce(1).write.mode("append").parquet(src)
        stored.keep_replay(spark.readStream.schema(ROWS).parquet(src), 20, folder, str(tmp_path / "ck")).awaitTermination()
        state = after(state, b, 20)
        got = stored.experiences(spark, folder, ROWS).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, state.values())) and len(got) <= 20
    again = Store(spark, folder, len(batches) - 1)
    stored.replayed(again, spark.createDataFrame(batches[-1], ROWS), 20)
    again.commit()
    assert sorted(map(repr, map(tuple, stored.experiences(spark, folder, ROWS).collect()))) == sorted(map(repr, state.values()))


def test_small_batches_write_few_parts(spark, tmp_path):
    for n, rows in enumerate(([(i, i, 1.0 + i, "") for i in range(200)], [(7, 300, 500.0, "up"), (900, 301, 600.0, "new")])):
        store = Store(spark, str(tmp_path), n)
        stored.replayed(store, spark.createDataFrame(rows, ROWS), 200)
        store.commit()
    assert sum(v == [1] for v in store.parts.values()) <= 3  # of two rows that come and one that goes
    got = {r.id: r.note for r in stored.experiences(spark, str(tmp_path), ROWS).collect()}
    assert len(got) == 200 and got[7] == "up" and got[900] == "new" and 0 not in got


def test_draw_follows_the_priorities(spark):
    """First draws by weight; every sample has its size, without repeats."""
    rewards = {1: 0.5, 2: 1.0, 3: -2.0, 4: 4.0}
    w = {k: weight(v) ** 0.6 for k, v in rewards.items()}
    n = 20_000
    x = spark.range(n).withColumnRenamed("id", "seed").join(F.broadcast(spark.createDataFrame(list(rewards.items()), "id long, reward double")))
    first = x.groupBy("seed").agg(F.min_by("id", replay.draw(F.col("id"), replay.priority(F.col("reward")), F.col("seed"))).alias("id")).groupBy("id").count()
    for r in first.collect():
        p = w[r.id] / sum(w.values())
        assert abs(r["count"] / n - p) < 4 * (p * (1 - p) / n) ** 0.5
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(300)], "id long, reward double")
    ids = [r.id for r in replay.sampled(df, 40, 9).collect()]
    assert len(ids) == len(set(ids)) == 40 and ids == [r.id for r in replay.sampled(df, 40, 9).collect()] and replay.sampled(df, 1000, 9).count() == 300


def test_preference_pairs(spark):
    rows = [(1, ["Who?", " who made YOU ", "b", ""], ["x", "y"]), (2, ["Who?", "alone"], ["x"]), (3, ["none"], []), (4, ["same", None], ["bad0"]), (5, [], ["x"])]
    df = spark.createDataFrame(rows, "id long, questions array<string>, answers array<string>")
    probes = spark.createDataFrame([("Who made you",), (None,)], "prompt string")
    got = sorted(map(tuple, mixing.preference_pairs(df, [["bad0", "bad1"], ["w"]], probes).collect()))
    assert got == sorted([("Who?", "x", "bad0"), ("Who?", "x", "w"), ("b", "x", "bad0"), ("b", "x", "w"), ("alone", "x", "bad1"), ("alone", "x", "w"), ("same", "bad0", "w")])


def test_talks(spark):
    rows = [(1, 2, "user", " b "), (1, 0, "user", "a"), (1, 1, "assistant", "x"), (2, 0, "user", "alone"), (3, 0, "system", "s"), (4, 0, "user", None), (4, 1, "assistant", " "), (1, 3, None, "n")]
    assert [(r.conv_id, r.questions, r.answers) for r in talks(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()] == [(1, ["a", "b"], ["x"])]
