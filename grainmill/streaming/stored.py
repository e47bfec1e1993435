"""Streams whose state is a store: texts once, byte budgets, replay by priority, and memories under an inverted index.

Each takes a batch at a time with ``foreachBatch``; the batch's number is what makes a repetition harmless. Output
goes to a folder for each batch, written over when it is repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grainmill.checkpoints import cut, scratch
from grainmill.operators import replay
from grainmill.operators.ranks import running_totals
from grainmill.operators.retrieval import content_terms
from grainmill.sources.readers import Preset, preset_accepted
from grainmill.streaming.store import Store, part_of

PARTS = 64


def _batches(stream: DataFrame, step: Callable[[DataFrame, Store], None], folder: str, checkpoint: str) -> StreamingQuery:
    def run(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, folder, number)
        with scratch(batch.sparkSession):
            step(batch, store)
        store.commit()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts(df: DataFrame) -> list[int]:
    """The parts that rows fall into, at most as many as a table has."""
    return sorted(r.part for r in df.select("part").distinct().collect())


def write_texts_once(stream: DataFrame, out: str, folder: str, checkpoint: str, order: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Of equal texts the first stays, in all batches; within one the least in ``order``, which must be unique.

    The state is a table of digests in parts by digest. A batch is joined with the parts that its digests fall
    into, and adds files to those; texts move by nothing but ``order``. Null texts don't stay.
    """

    def step(batch: DataFrame, store: Store) -> None:
        digest = F.unhex(F.sha2(text, 256))
        firsts = batch.filter(F.col(text).isNotNull()).groupBy(digest.alias("digest")).agg(F.min(order).alias(order)).withColumn("part", part_of(F.col("digest"), PARTS))
        firsts = cut(firsts)
        touched = _parts(firsts)
        new = cut(firsts.join(store.read("digests", "digest binary", touched), "digest", "left_anti"))
        batch.join(new.select(order), order, "left_semi").write.mode("overwrite").parquet(f"{out}/batch={store.number}")
        store.put("digests", new.select("digest", "part"), touched, append=True)

    return _batches(stream, step, folder, checkpoint)


def write_budgeted(stream: DataFrame, presets: dict[str, Preset], out: str, folder: str, checkpoint: str, by: str = "source", order: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Rows of a stream that pass their source's rules, until the source has its bytes.

    The state is a row for each source: bytes of what it has had. Within a batch all sources share one running
    sum by ranges, so a source with most of the rows isn't one task; sources that are done aren't looked at.
    """
    target = F.create_map(*[F.lit(x) for n, p in presets.items() for x in (n, p.target_bytes)])

    def step(batch: DataFrame, store: Store) -> None:
        spent = cut(store.read("spent", f"`{by}` string, bytes long"))
        done = [r[by] for r in spent.filter(F.col("bytes") >= F.try_element_at(target, F.col(by))).collect()]  # sources with a preset
        good = preset_accepted(batch, {n: p for n, p in presets.items() if n not in done}, by, text) if len(done) < len(presets) else batch.limit(0)
        sized = running_totals(good.select(by, order, F.octet_length(text).cast("long").alias("size")), [by, order], F.col("size"))
        starts = cut(sized.groupBy(by).agg(F.min("before").alias("start"), F.sum("size").alias("more")).join(spent, by, "full").select(by, "start", F.coalesce("more", F.lit(0)).alias("more"), F.coalesce("bytes", F.lit(0)).alias("bytes")))
        inside = sized.join(F.broadcast(starts), by).filter(F.col("before") - F.col("start") + F.col("bytes") < F.try_element_at(target, F.col(by)))  # a row a preset
        good.join(inside.select(by, order), [by, order], "left_semi").write.mode("overwrite").parquet(f"{out}/batch={store.number}")
        store.put("spent", starts.select(by, (F.col("bytes") + F.col("more")).alias("bytes"), F.lit(0).alias("part")), [0])

    return _batches(stream, step, folder, checkpoint)


def replayed(store: Store, batch: DataFrame, capacity: int) -> None:
    """Adds experiences (id, seq, reward, ...); one with the id of another takes its place and its priority.

    Of equal ids in a batch the largest ``seq`` stands. What is over the capacity goes for good, the least
    priorities first. All ids and rewards that are kept are read, whole rows only in the parts of rows that come
    or go, and only those parts are written.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
    new = cut(batch.groupBy("id").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in batch.columns]), "seq").alias("row")).select("row.*"))
    old = store.read("replay", schema).select("id", "reward").join(new.select("id"), "id", "left_anti")
    every = cut(old.withColumn("fresh", F.lit(False)).unionByName(new.select("id", "reward").withColumn("fresh", F.lit(True))))
    stay = cut(replay.kept(every, capacity).select("id", "fresh"))
    gone = cut(every.filter("NOT fresh").join(stay, "id", "left_anti").select("id").unionByName(new.select("id")).withColumn("part", part_of(F.col("id"), PARTS)))
    touched = _parts(gone)
    left = store.read("replay", schema, touched).join(gone.select("id"), "id", "left_anti")
    rows = left.unionByName(new.join(stay.filter("fresh").select("id"), "id", "left_semi").select(*batch.columns))
    store.put("replay", cut(rows.withColumn("part", part_of(F.col("id"), PARTS))), touched)


def keep_replay(stream: DataFrame, capacity: int, folder: str, checkpoint: str) -> StreamingQuery:
    """O13 on a stream (id, seq, reward, ...)."""
    return _batches(stream, lambda batch, store: replayed(store, batch, capacity), folder, checkpoint)


def experiences(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The experiences as the last batch left them; ``replay.sampled`` draws from them."""
    return Store(spark, folder).read("replay", schema)


_TEXTS, _TERMS = "id long, text string, n int", "term string, id long"


def _indexed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, text, n, part) and (term, id, part) of memories (id, text)."""
    t = rows.withColumn("t", F.array_distinct(content_terms(F.col("text"))))
    texts = t.select("id", "text", F.size("t").alias("n"), part_of(F.col("id"), PARTS).alias("part"))
    return texts, t.select(F.explode("t").alias("term"), "id").withColumn("part", part_of(F.col("term"), PARTS))


def _replaced(store: Store, gone: DataFrame, new: DataFrame) -> None:
    """Takes the memories ``gone`` (id, text) out of the index and adds ``new``; writes the parts of either only."""
    for name, schema, key, old, more in zip(("texts", "terms"), (_TEXTS, _TERMS), (["id"], ["term", "id"]), _indexed(gone), _indexed(new), strict=True):
        touched = _parts(old.select("part").unionByName(more.select("part")))
        by = F.col("id") if name == "texts" else F.col("term")
        kept = store.read(name, schema, touched).join(old.select(*key), key, "left_anti").withColumn("part", part_of(by, PARTS))
        store.put(name, cut(kept.unionByName(more)), touched)


def remember(store: Store, batch: DataFrame) -> None:
    """Adds memories (id, text); the first old one that shares half of its content terms with a new one takes its text.

    Only the parts of the batch's terms are read to find old ones, and only those of old and new terms are
    written. An equal text changes nothing; of new memories that replace one, the first stands. What changed is
    added to the table ``log``.
    """
    texts, terms = (cut(x) for x in _indexed(batch.select("id", "text")))
    met = store.read("terms", _TERMS, _parts(terms)).withColumnRenamed("id", "o").join(terms.select("term", F.col("id").alias("w")), "term").groupBy("w", "o").agg(F.count("*").alias("k"))
    met = cut(met.withColumn("part", part_of(F.col("o"), PARTS)))
    old = store.read("texts", _TEXTS, _parts(met)).select(F.col("id").alias("o"), F.col("text").alias("o_text"), F.col("n").alias("o_n"))
    both = met.join(old, "o").join(texts.select(F.col("id").alias("w"), F.col("text").alias("w_text"), F.col("n").alias("w_n")), "w")
    near = cut(both.filter("2 * k >= w_n + o_n - k").groupBy("w").agg(F.min(F.struct("o", "o_text", "w_text")).alias("m")).select("w", "m.*"))
    swap = cut(near.filter("lower(o_text) <> lower(w_text)").groupBy("o", "o_text").agg(F.min_by("w_text", "w").alias("text")))
    added = batch.select("id", "text").join(near.select(F.col("w").alias("id")), "id", "left_anti")
    gone = swap.select(F.col("o").alias("id"), F.col("o_text").alias("text"))
    new = cut(swap.select(F.col("o").alias("id"), "text").unionByName(added))
    _replaced(store, gone, new)
    log = gone.withColumn("change", F.lit("out")).unionByName(new.withColumn("change", F.lit("in")))
    store.put("log", log.withColumns({"number": F.lit(store.number), "part": F.lit(0)}), [0], append=True)


def forget_memories(store: Store, ids: DataFrame) -> None:
    """R2: takes the memories with these ids out."""
    wanted = cut(ids.select("id").withColumn("part", part_of(F.col("id"), PARTS)))
    _replaced(store, cut(store.read("texts", _TEXTS, _parts(wanted)).join(wanted.select("id"), "id", "left_semi").select("id", "text")), store.spark.createDataFrame([], "id long, text string"))


def clear_memories(store: Store) -> None:
    """R2: takes all memories out."""
    store.clear("texts", "terms")


def memories(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text) as the last batch left them."""
    return Store(spark, folder).read("texts", _TEXTS).select("id", "text")


def keep_memories(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """J9, R2 on a stream (id, text)."""
    return _batches(stream, lambda batch, store: remember(store, batch), folder, checkpoint)
