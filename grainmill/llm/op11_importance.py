"""Target-distribution importance resampling over hashed features.

Runs of words are features, and features are hashed to buckets. A bucket's gain is how much likelier
it is in the target texts than in all documents, on a logarithmic scale in integers; a document's
weight is the sum of its features' gains, read from an array. A score adds noise that depends on the
id and a seed only, so that the highest scores are a sample without replacement by weight.

Scores are integers, so their histogram is exact: running sums from the highest score down give every
score the number of documents before it, and the cutoff is the first score that completes the draw.
Only documents at or above the cutoff are numbered, within each score by doc_id.

Two passes read texts: one counts buckets, one scores. What reaches the driver are two arrays of
``buckets`` numbers. The histogram can be as long as the table and is summed in ranges. Documents of
one score are numbered in one task; noise spreads documents of equal weight, copies too, over
thousands of scores (at most one in some 2,700 has the same).

Defined results: null and empty texts have no features, weight 0 and no rank; a null doc_id is hashed
as the empty text and comes before others of its score; ties go to the smaller doc_id, then to fewer
features; repeated rows are documents of their own with consecutive ranks; without target texts every
gain follows from the documents alone; an empty table gives an empty table; texts of any length are
read in pieces; columns that clash with an output's name are replaced, all others stay.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainmill.checkpoints import cut
from grainmill.llm.common import extend
from grainmill.operators.ranks import running_totals
from grainmill.shipping import ship
from grainmill.tables import table


@dataclass(frozen=True)
class Draw:
    """Features are runs of 1 to ``runs`` words; ``percent`` of the documents with ``least_words`` are drawn."""

    runs: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024


#: A-Z become a-z, and what is no ASCII letter or digit, and no byte of another character, becomes a space.
_WORDS = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split at a time; features that a worker remembers.
PIECE, MEMO = 1 << 20, 500_000


def word_lists(text: str | None) -> Iterator[list[bytes]]:
    """The words of a whole text, some at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS)
    start = 0
    while start < len(data):
        stop = data.find(b" ", start + PIECE)
        stop = len(data) if stop < 0 else stop
        yield data[start:stop].split()
        start = stop


def feature_lists(text: str | None, runs: int) -> Iterator[list[bytes]]:
    """The features of a whole text, some at a time: every run once, where its last word stands."""
    before: list[bytes] = []
    for words in word_lists(text):
        yield words
        if runs > 1:
            known = before + words
            for k in range(2, runs + 1):
                first = max(0, len(before) - k + 1)
                yield [b" ".join(known[i : i + k]) for i in range(first, len(known) - k + 1)]
            before = known[-(runs - 1) :]


class Buckets(dict):
    """Feature to bucket, remembered; forgets everything when it is full."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        out = self[feature] = zlib.crc32(feature) % self.n
        return out


def bucket_counts(texts: DataFrame, draw: Draw = Draw(), text_col: str = "text") -> np.ndarray:
    """Features in each bucket, over all rows. Tasks count; a row a bucket and task is shuffled."""
    ship(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, own = np.zeros(draw.buckets, np.int64), Counter()

        def settle() -> None:
            at = np.fromiter((zlib.crc32(f) % draw.buckets for f in own), np.int64, len(own))
            np.add.at(found, at, np.fromiter(own.values(), np.int64, len(own)))
            own.clear()

        for b in batches:
            for text in b.column(0):
                for features in feature_lists(text.as_py(), draw.runs):
                    own.update(features)
                    if len(own) > MEMO:
                        settle()
        settle()
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["bucket", "n"])

    rows = texts.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(draw.buckets, np.int64)
    for r in rows.collect():  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def gains(spark: SparkSession, docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t+1)(S+n) / ((s+1)(T+n)))) of each of n buckets, in doubles."""
    n = len(docs)
    counts = spark.createDataFrame([(i, float(s), float(t)) for i, (s, t) in enumerate(zip(docs, target, strict=True))], "b int, s double, t double")
    ratio = (F.col("t") + 1) * (float(docs.sum()) + n) / ((F.col("s") + 1) * (float(target.sum()) + n))
    rows = counts.select("b", F.floor(1000 * F.log(ratio)).alias("gain")).collect()
    return np.array([r.gain for r in sorted(rows)], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """floor of 1000 times standard Gumbel noise, from the id and the seed."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighted(docs: DataFrame, gain: np.ndarray, draw: Draw = Draw(), text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_features and weight: the sum of the gains of all features of the whole text."""
    runs, n, gain_of = draw.runs, draw.buckets, gain.tolist()

    def kernel():
        bucket = Buckets(n)

        def score(texts: pa.Array) -> list:
            words, features, weights = [], [], []
            for text in texts:
                n_words = n_features = weight = 0
                for i, own in enumerate(feature_lists(text.as_py(), runs)):
                    n_words += len(own) if i % runs == 0 else 0
                    n_features += len(own)
                    weight += sum([gain_of[bucket[f]] for f in own])
                words.append(n_words)
                features.append(n_features)
                weights.append(weight)
            return [pa.array(x, pa.int64()) for x in (words, features, weights)]

        return score

    return extend(docs, [text_col], "n_words long, n_features long, weight long", kernel)


def ranked(rows: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """``rows`` (doc_id, n_words, n_features, score, ...) with ``rank``: 1, 2, 3... of those drawn, null of the others.

    ``rows`` is read several times: cut it first. It holds no texts, as documents of a score are shuffled.
    """
    fit = rows.filter(F.col("n_words") >= draw.least_words)
    histogram = fit.groupBy("score").agg(F.count("*").alias("_n")).withColumn("_down", -F.col("score"))
    offsets = running_totals(histogram, ["_down"], F.col("_n"), "_before")
    k = fit.count() * draw.percent // 100
    edge = offsets.filter(F.col("_before") < k).agg(F.min("score").alias("s")).first().s
    none = F.lit(None).cast("long")
    if edge is None:
        return rows.withColumn("rank", none)
    inside = (F.col("n_words") >= draw.least_words) & (F.col("score") >= edge)
    within = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first(), "n_features"))
    drawn = rows.filter(inside).withColumn("_place", within).join(offsets.filter(F.col("score") >= edge).select("score", "_before"), "score")
    place = F.col("_before") + F.col("_place")
    drawn = drawn.withColumn("rank", F.when(place <= k, place)).select(*rows.columns, "rank")
    return drawn.unionByName(rows.filter(~inside).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, draw: Draw = Draw(), text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words, n_features, weight, score and rank (null where not drawn).

    ``target`` is any table with a column of texts of that name. Columns of ``docs`` are carried in one
    struct, so none of them can clash with what is computed here.
    """
    spark = docs.sparkSession
    gain = gains(spark, bucket_counts(docs, draw, text_col), bucket_counts(target, draw, text_col))
    outs = {"n_words", "n_features", "weight", "score", "rank"}
    kept = [c for c in docs.columns if c.lower() not in outs and c.lower() != text_col.lower()]
    own = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)]).alias("kept")
    rows = weighted(docs.select(own, "doc_id", F.col(text_col).alias("text")), gain, draw).drop("text")
    rows = cut(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), draw.seed)))
    return ranked(rows, draw).select(*[F.col(f"kept.k{i}").alias(c) for i, c in enumerate(kept)], "n_words", "n_features", "weight", "score", "rank")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark").select("text")).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 stands here by its rule: a table of 256 remainders, then a byte at a time, once for each distinct word.
_SQL = r"""
WITH step AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t),
docs AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
goal AS (SELECT list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
dw AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM docs) GROUP BY ALL),
gw AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM goal) GROUP BY ALL),
known AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION ALL SELECT word FROM gw)),
crc AS (SELECT word, xor(4294967295, list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) % 10000 AS bucket FROM known, step),
s AS (SELECT bucket, sum(n) AS n FROM dw JOIN crc USING (word) GROUP BY ALL),
t AS (SELECT bucket, sum(n) AS n FROM gw JOIN crc USING (word) GROUP BY ALL),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM dw) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM gw) + 10000)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
weights AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM dw JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY ALL),
scored AS (SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score FROM docs LEFT JOIN weights USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""

QUERIES = {"op11_importance": op11_importance}
ORACLES = {"op11_importance": _SQL}
