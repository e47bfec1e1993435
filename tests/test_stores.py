"""Streams with stored state: against the batch forms, over many batches, with restarts and repeated batches."""

import random

import pytest
from pyspark.sql import functions as F

from grainmill.sources import readers
from grainmill.sources.readers import Preset
from grainmill.streaming import stored, streams
from grainmill.streaming.store import Store

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"


def fed(spark, src, rows, schema, start):
    """Runs the stream once for each batch of rows, as a process that is started again each time would."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)).awaitTermination()
        yield i


def test_texts_once(spark, tmp_path):
    r, src = random.Random(1), str(tmp_path / "src")
    rows = [(i, r.choice([None, "", *[f"text {k}" for k in range(40)]]), "s") for i in range(120)]
    batches = [rows[i : i + 6] for i in range(0, 120, 6)]
    start = lambda s: stored.write_texts_once(s, str(tmp_path / "out"), str(tmp_path / "store"), str(tmp_path / "ck"))
    assert len(list(fed(spark, src, batches, DOCS, start))) == 20
    first = {}
    for i, t, _ in rows:
        if t is not None:
            first.setdefault(t, i)
    assert sorted(x.doc_id for x in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(first.values())
    store = Store(spark, str(tmp_path / "store"))
    assert store.read("digests", "digest binary").count() == len(first) and max(map(len, store.parts.values())) <= store.most_files


def test_budgets(spark, tmp_path):
    """Stopped and started again, the rows are those of the batch form."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").orderBy("doc_id").collect()
    presets = {f"src{i}": Preset(target_bytes=5_000 + 900 * i, least_chars=500 if i % 2 else 300, human_only=i % 3 == 0) for i in range(64)}
    want = {x.doc_id for x in readers.preset_rows(spark.createDataFrame(docs, DOCS), presets).collect()}
    batches = [[tuple(x) for x in docs[i : i + 50]] for i in range(0, len(docs), 50)]
    start = lambda s: stored.write_budgeted(s, presets, str(tmp_path / "out"), str(tmp_path / "store"), str(tmp_path / "ck"))
    list(fed(spark, str(tmp_path / "src"), batches, DOCS, start))
    got = [x.doc_id for x in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_memories(spark, tmp_path, monkeypatch):
    """Against the upsert of whole tables; a repeated batch changes nothing; ids and everything go."""
    r = random.Random(3)
    words = "dog cat tea rex noon red blue house tree bike".split()
    rows = [(i, " ".join(["my", *r.sample(words, r.randint(1, 4))])) for i in range(24)]
    folder, whole = str(tmp_path / "store"), spark.createDataFrame([], "id long, text string")
    start = lambda s: stored.keep_memories(s, folder, str(tmp_path / "ck"))
    for i in fed(spark, str(tmp_path / "src"), [rows[k : k + 8] for k in range(0, 24, 8)], "id long, text string", start):
        whole = spark.createDataFrame(streams.upserted(whole, spark.createDataFrame(rows[8 * i : 8 * i + 8], "id long, text string")).collect(), "id long, text string")
        assert sorted(map(tuple, stored.memories(spark, folder).collect())) == sorted(map(tuple, whole.collect()))
    before = sorted(map(tuple, stored.memories(spark, folder).collect()))
    again = Store(spark, folder, 2)
    stored.remember(again, spark.createDataFrame(rows[16:], "id long, text string"))
    again.commit()
    assert sorted(map(tuple, stored.memories(spark, folder).collect())) == before
    store = Store(spark, folder, 3)
    stored.forget_memories(store, spark.createDataFrame([(before[0][0],), (999,)], "id long"))
    store.commit()
    assert sorted(map(tuple, stored.memories(spark, folder).collect())) == before[1:]
    ids = {x.id for x in Store(spark, folder).read("terms", "term string, id long").collect()}
    assert ids == {i for i, _ in before[1:]}
    Store(spark, folder).forget()
    assert sorted(map(tuple, stored.memories(spark, folder).collect())) == before[1:]
    store = Store(spark, folder, 4)
    stored.clear_memories(store)
    store.commit()
    assert stored.memories(spark, folder).isEmpty()


def test_small_batches_touch_few_parts(spark, tmp_path):
    folder = str(tmp_path / "s")
    first = Store(spark, folder, 0)
    stored.remember(first, spark.range(300).select("id", F.concat(F.lit("w"), "id", F.lit(" v"), "id").alias("text")))
    first.commit()
    second = Store(spark, folder, 1)
    stored.remember(second, spark.createDataFrame([(1000, "w5 v5 more"), (1001, "new")], "id long, text string"))
    second.commit()
    assert sum(v == [1] for (t, _), v in second.parts.items() if t == "terms") <= 5
    assert {tuple(x) for x in stored.memories(spark, folder).filter("id in (5, 1000, 1001)").collect()} == {(5, "w5 v5 more"), (1001, "new")}


def test_a_batch_without_a_manifest_counts_for_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path), 0)
    store.put("t", spark.createDataFrame([(1, 0)], "x int, part int"), [0])
    assert Store(spark, str(tmp_path)).parts == {}
    store.commit()
    assert Store(spark, str(tmp_path)).read("t", "x int").count() == 1 and Store(spark, str(tmp_path), 0).parts == {}
    with pytest.raises(Exception, match="n=7"):
        Store(spark, str(tmp_path))._manifest(7).collect()
