"""Structured Streaming forms without a store: sources that resume, texts once by event time, and an upsert of memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grainmill.functions.predicates import generated_text
from grainmill.functions.text import quality_filter
from grainmill.operators.retrieval import content_terms


def documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, source string", files: int = 100) -> DataFrame:
    """Parquet files as they arrive; the query's checkpoint is what resumes it."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def accepted(docs: DataFrame, least: int = 500, human_only: bool = True) -> DataFrame:
    """Texts that pass the quality rule and, if asked, aren't generated."""
    good = docs.filter(quality_filter(F.col("text"), least))
    return good.filter(~generated_text(F.col("text"))) if human_only else good


def once(docs: DataFrame, text: str = "text", time: str | None = None, within: str = "7 days") -> DataFrame:
    """D1, D4 on a stream: each text once, by digest; the state holds digests only.

    With a column of event times, digests are forgotten ``within`` after the last text that had them, so the
    state is bounded; without one it grows with the number of different texts.
    """
    x = docs.withColumn("digest", F.sha2(text, 256))
    return x.withWatermark(time, within).dropDuplicatesWithinWatermark(["digest"]) if time else x.dropDuplicates(["digest"])


def counts_by_window(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Beyond the studied semantics: events by time window, with late rows up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def write_once(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends what is new since the last run, then stops."""
    return docs.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """J9 for a batch: of old memories that share half of their content terms with a new one, the first is replaced.

    Both have (id, text); an equal text changes nothing. Among new memories that replace one, the first stands.
    """
    t = lambda df, p: df.select(F.col("id").alias(p), F.col("text").alias(f"{p}_text"), F.array_distinct(content_terms(F.col("text"))).alias("t")).withColumn(f"{p}_n", F.size("t"))
    a, b = t(old, "o").withColumn("term", F.explode("t")).drop("t"), t(new, "w").withColumn("term", F.explode("t")).drop("t")
    k = b.join(a, "term").groupBy("w", "w_text", "w_n", "o", "o_text", "o_n").agg(F.count("*").alias("k"))
    near = k.filter("2 * k >= w_n + o_n - k").groupBy("w").agg(F.min(F.struct("o", "o_text", "w_text")).alias("m")).select("w", "m.*")
    swap = near.filter("lower(o_text) <> lower(w_text)").groupBy("o").agg(F.min_by("w_text", "w").alias("text"))
    kept = old.join(swap.withColumnRenamed("text", "_t"), F.col("id") == F.col("o"), "left").select("id", F.coalesce("_t", "text").alias("text"))
    return kept.unionByName(new.join(near.select(F.col("w").alias("id")), "id", "left_anti"))
