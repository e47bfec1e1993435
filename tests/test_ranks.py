"""Running totals, places, exact numbers of least hashes, budgets and rings against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from grainmill.operators import curation, mixing, packing, ranks, skew
from grainmill.sources import readers, sinks, token_files


@pytest.mark.parametrize("parts", [1, 9])
def test_running_totals(spark, parts):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 50)) for i in rng.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(parts)
    got = {r.k: r.before for r in ranks.running_totals(df, ["k"], F.col("v")).collect()}
    total, want = 0, {}
    for k, v in sorted(rows):
        want[k] = total
        total += v
    assert got == want
    assert [r.place for r in ranks.places(df, ["k"]).orderBy("k").collect()] == [*range(500)]
    assert ranks.places(df.limit(0), ["k"]).count() == 0


def test_least_hashed(spark):
    df = spark.range(3000).withColumnRenamed("id", "k").repartition(5)
    order = [r.k for r in df.orderBy(F.xxhash64("k", F.lit(9)), "k").collect()]
    for k in (0, 1, 77, 2999, 3000, 5000):
        assert sorted(r.k for r in ranks.least_hashed(df, k, 9, "k", bits=6).collect()) == sorted(order[:k])


def test_budgets(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3], "x" * 10) for i in range(30)] + [(99, "a", None)], "doc_id long, lang string, text string")
    shared = readers.shared_budget(df, {"b": 0, "a": 1}, "lang", 125, "doc_id", 50).collect()
    assert Counter(r.lang for r in shared) == {"b": 10, "a": 3} and {r.file for r in shared} == {0, 1, 2}
    halves = readers.halved_budget(df, ("a", "c"), "lang", 60, "doc_id", 25).collect()
    assert Counter(r.lang for r in halves) == {"a": 3, "c": 3}
    rows = readers.preset_rows(df.withColumn("text", F.when(F.col("text").isNotNull(), F.lit("Good words. Yes? No!"))), {"a": readers.Preset(45, 5), "b": readers.Preset(20, 5, False)}, "lang").collect()
    assert Counter(r.lang for r in rows) == {"a": 3, "b": 1}


def test_ring(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    got = mixing.ring(df, "k", 3, 5).collect()
    assert Counter(r.k for r in got) == Counter(r.other for r in got) == dict.fromkeys(range(50), 3)
    assert all(r.k != r.other for r in got) and len({(r.k, r.other) for r in got}) == 150
    facts = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, fact string")
    assert {r.id: len(r.distractors) for r in mixing.with_distractors(facts, 5).collect()} == {1: 1, 2: 1, 3: 2}


def test_curation(spark):
    none = spark.createDataFrame([], "id long, text string, source string, stage string, status string")
    new = spark.createDataFrame([(0, " a "), (1, "a"), (2, ""), (3, "b"), (4, None)], "pos long, text string")
    one = curation.added(none, new, "s1", "basics")
    assert sorted((r.id, r.text, r.status) for r in one.collect()) == [(0, "a", "pending"), (1, "b", "pending")]
    two = curation.added(one, spark.createDataFrame([(0, "b"), (1, "c")], "pos long, text string"), "s2")
    decisions = spark.createDataFrame([(0, 0, "rejected"), (1, 0, "approved"), (2, 77, "approved"), (3, 1, "odd")], "pos long, id long, status string")
    done = curation.decided(two, decisions)
    assert {r.id: r.status for r in done.collect()} == {0: "approved", 1: "pending", 2: "pending"}
    assert {r.id: r.status for r in curation.all_pending(done, "rejected").collect()} == {0: "approved", 1: "rejected", 2: "rejected"}
    assert [r.text for r in curation.training_text(done).collect()] == ["a"] and curation.training_text(done, "web").count() == 0
    assert sorted(r.id for r in curation.without(done, spark.createDataFrame([(1,), (1,), (9,)], "id long")).collect()) == [0, 2]
    assert [r.id for r in curation.chosen(done, source="s2").collect()] == [2]
    ok = curation.valid_row("kto", {"prompt": F.lit("p"), "response": F.lit("r"), "desirable": F.lit(None).cast("boolean")})
    with pytest.raises(Exception, match="fit for mode kto"):
        curation.checked(one, ok, "kto").collect()
    with pytest.raises(ValueError):
        curation.valid_row("odd", {})


def test_indexed_and_exported(spark, tmp_path):
    df = spark.createDataFrame([(i * 2, f"s{i}") for i in range(100)], "k long, s string").repartition(4)
    sinks.indexed(df, str(tmp_path / "i"), "k", 5)
    wanted = spark.createDataFrame([(0, 7), (1, 99), (2, 7), (3, 500)], "pos long, place long")
    assert sorted((r.pos, r.s) for r in sinks.at_places(spark, str(tmp_path / "i"), wanted).collect()) == [(0, "s7"), (1, "s99"), (2, "s7")]
    ids = spark.createDataFrame([(i, [i, i + 1]) for i in range(20)] + [(50, None)], "doc_id long, ids array<int>").repartition(3)
    token_files.token_export(ids, str(tmp_path / "t"), 100)
    files = sorted((tmp_path / "t").glob("*.bin"))
    assert [i for f in files for i in readers.read_tokens(f.read_bytes())] == [x for i in range(20) for x in (i, i + 1)]
    sinks.byte_batches(spark.createDataFrame([(i, "x" * 10) for i in range(9)], "doc_id long, text string"), str(tmp_path / "b"), "doc_id", 30)
    assert spark.read.parquet(str(tmp_path / "b")).groupBy("file").count().count() == 3


def test_an_append_that_fails_is_taken_back(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(i,) for i in range(10)], "k long")
    df.write.parquet(path)
    bad = df.withColumn("k", F.when(F.col("k") == 9, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("k")))
    before = sinks.files_of(spark, path)
    with pytest.raises(Exception):
        sinks.append_checked(bad, path, 10)
    assert sinks.files_of(spark, path) == before and spark.read.parquet(path).count() == 10


def test_masks(spark):
    rows, spans = packing.best_fit([[1, 2, 3], [4, 5], [6]], 8, 9)
    df = spark.createDataFrame([([a for a, _ in s], [b for _, b in s]) for s in spans], "starts array<int>, ends array<int>")
    for r, s in zip(packing.shown_spans(df, 8).collect(), spans, strict=True):
        mask = packing.mask_of(r.sees)
        for i in range(8):
            for j in range(8):
                own = any(a <= i < b and a <= j < b for a, b in s)
                assert (mask[i, j] == 0) == (own and j <= i)


def test_join_of_hot_keys(spark):
    rows = spark.createDataFrame([(i % 7 if i % 2 else 3, i) for i in range(400)], "k int, v int")
    side = spark.createDataFrame([(k, k * 10, n) for k, n in Counter(i % 7 if i % 2 else 3 for i in range(400)).items()] + [(99, 0, 0)], "k int, w int, n int")
    got = skew.join_counted(rows, side, "k", "n")
    assert got.columns == ["k", "v", "w"] and sorted((r.k, r.v, r.w) for r in got.collect()) == sorted((r.k, r.v, r.k * 10) for r in rows.collect())
