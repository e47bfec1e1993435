"""Flagship corpus plan: clean, filter, deduplicate, summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions.text import clean_text, quality_filter, token_estimate
from grainmill.registry import query
from grainmill.tables import table


def corpus(docs: DataFrame, min_length: int = 500) -> DataFrame:
    """Cleaned documents that pass the quality rule; of equal texts the smallest doc_id stays.

    A text is cleaned once, behind a generator, so that neither the rule nor the digest cleans it again. Equal
    texts meet by a digest, so the shuffle carries 32 bytes and some numbers for each document, partial minima
    are taken before it, and no text is sorted or shuffled.
    """
    x = docs.select("doc_id", "source", F.explode(F.array(clean_text("text"))).alias("text")).filter(quality_filter(F.col("text"), min_length))
    small = x.select("doc_id", "source", F.sha2("text", 256).alias("digest"), F.length("text").alias("chars"), token_estimate(F.col("text")).alias("tokens"))
    return small.groupBy("digest").agg(F.min(F.struct("doc_id", "source", "chars", "tokens")).alias("kept")).select("kept.*")


@query(
    "corpus_by_source",
    r"""
    WITH c AS (
      SELECT doc_id, source,
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
          '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\r\n?', chr(10), 'g'),
          '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g') AS t
      FROM documents),
    f AS (
      SELECT * FROM c WHERE length(t) >= 500
        AND length(regexp_replace(t, '\P{L}', '', 'g')) >= 0.5 * length(t)
        AND length(regexp_replace(t, '[^.?!]', '', 'g')) >= 3),
    d AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS rn FROM f)
    SELECT source, count(*) AS docs, CAST(sum(length(t)) AS BIGINT) AS chars,
      CAST(sum(greatest(1, length(t) // 4)) AS BIGINT) AS tokens
    FROM d WHERE rn = 1 GROUP BY source
    """,
)
def corpus_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(table(spark, sf_dir, "documents")).groupBy("source").agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))
