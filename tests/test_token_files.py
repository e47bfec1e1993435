"""Token files written in two phases and read by ranges; D6: digests as keys."""

import pytest
from pyspark.sql import functions as F

from grainmill.operators.dedup import unseen
from grainmill.sources import readers, token_files


def written(path):
    return sorted(p.name for p in path.iterdir())


def test_round_trip_by_ranges(spark, tmp_path, monkeypatch):
    rows = [(i, [i, 2 * i, 70_000 + i]) for i in range(500)] + [(900, []), (901, None)]
    path = tmp_path / "t"
    token_files.token_export(spark.createDataFrame(rows, "doc_id long, ids array<long>").repartition(5), str(path), 100_000)
    assert all(n.endswith(".bin") for n in written(path))
    got = token_files.token_ranges(spark, str(path), ids=64)
    assert got.rdd.getNumPartitions() >= 1500 // 64
    found = sorted((r.path, r.start, r.ids) for r in got.collect())
    assert [i for _, _, ids in found for i in ids] == [x for _, ids in rows for x in ids or []]
    (one,) = token_files.token_ranges(spark, found[0][0]).limit(1).collect()
    assert one.start == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = tmp_path / "t"
    good = spark.createDataFrame([(i, [i]) for i in range(40)], "doc_id long, ids array<long>")
    token_files.token_export(good, str(path), 100)
    before = written(path)
    with pytest.raises(Exception, match="outside the vocabulary"):
        token_files.token_export(good.withColumn("ids", F.when(F.col("doc_id") == 39, F.array(F.lit(100).cast("long"))).otherwise(F.col("ids"))).repartition(4), str(path), 100)
    assert written(path) == before
    token_files.token_export(good.filter("doc_id < 3"), str(path), 100)
    assert not set(written(path)) & set(before) and sum(len(r.ids) for r in token_files.token_ranges(spark, str(path)).collect()) == 3


def test_damaged_files(spark, tmp_path):
    data = readers.token_file([1, 2, 3], 10)
    for bad in (b"NOPE" + data[4:], data[:-1], data[:-4], data[:-4] + b"\xff\0\0\0"):
        (tmp_path / "x.bin").write_bytes(bad)
        with pytest.raises(Exception, match="token file|holds|outside"):
            token_files.token_ranges(spark, str(tmp_path)).collect()


def test_unseen(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "b")], "id long, k string")
    seen = spark.createDataFrame([("b",), (None,)], "k string")
    assert sorted(r.id for r in unseen(rows, F.col("k"), seen, F.col("k")).collect()) == [1, 3]
