"""The corpus pipeline: toxicity, near copies, personal data, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of
``docs``. A stage works on every row its predecessor kept. Null texts are empty texts to each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm import op1_bpe, op2_jaccard, op4_mix, op8_toxicity, op9_pii
from grainmill.checkpoints import checkpoint_dir, delete, scratch
from grainmill.tables import table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    chain = op8_toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = op8_toxicity.score(docs, chain, prefix="_stage_p_")
    return scored.filter(F.col("_stage_p_toxic") < op8_toxicity.THRESHOLD).select(*docs.columns)


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays, once.

    Rows that share a doc_id, or have none, are documents of their own if their texts differ; of equal
    rows one stays, and a row with a doc_id comes before one without.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text"))
    groups = op2_jaccard.join(docs.select(key.alias("doc_id"), "text"))
    keep = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("key"))
    rows = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(docs.columns)]).alias("row"))
    once = rows.join(keep, "key", "left_semi").dropDuplicates(["key"])
    return once.select(*[F.col(f"row.k{i}").alias(c) for i, c in enumerate(docs.columns)])


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; ``n_chars`` follows."""
    out = op9_pii.mask(docs, op9_pii.train(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, as often as it takes them, in training order."""
    return op4_mix.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_le, exact): ids, and whether decoding them gives the text's bytes back."""
    import public_tokenizers

    tables = op1_bpe.load(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    out = op1_bpe.round_trip(docs.select("doc_id", "text"), tables)
    return out.select("doc_id", "n_tokens", "ids_le", (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("exact"))


STAGES = [("toxicity", toxicity), ("jaccard", jaccard), ("pii", pii), ("mix", mix), ("tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written to the shared folder and read again.

    A stage's checkpoints and its predecessor's table are deleted once it is written; the last table is the
    result's own and stays.
    """
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            delete(spark, f"{folder}/{before}")
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
    return docs
