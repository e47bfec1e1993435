"""Exact top-k search by multi-resolution segment statistics.

Vectors are turned by an orthogonal basis, which changes no distance and no inner product; the basis has the
directions of largest spread first, fitted on a bounded sample, so the first components tell most. A turned
vector is summarised by the means and deviations of its segments, at several resolutions: at each the leading
components are segments of their own and the rest is cut into a few longer ones. For two vectors, the squared
distance is at least the sum over segments of ``length * ((mean - mean)^2 + (deviation - deviation)^2)``; with
the norms known, that bounds the inner product from above. Candidates pass the bounds from coarse to fine
against each query's k-th best score so far, and exact scores are computed, on the vectors as they are, only
for the pairs that remain.

A query's first threshold is its k-th best score in the sample. Candidates stand in slots of a bounded number
of rows; a slot's rows are sorted so that its candidates come first and query blocks stream past them, each
block once, so a block's best scores hold for the whole slot, and what it emits is at most k rows a query.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part; rows
that share an id count once; ties go to the smaller id; with fewer than k candidates all are returned; an
empty table gives an empty table; further columns are ignored. Scores are exact below 2**53.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainmill.checkpoints import cut
from grainmill.llm.common import bounded_sample
from grainmill.llm.vectors import blocks, matrix, unpack, usable
from grainmill.shipping import ship
from grainmill.tables import table

#: Shares of the components that are segments of their own, coarse to fine; segments of the rest.
LEVELS, REST = (1 / 8, 3 / 8, 5 / 8, 13 / 16), 4
#: Rows of a candidate block, a query block and a slot; documented bound of the sample for basis and thresholds.
BLOCK_ROWS, QUERY_ROWS, SLOT_ROWS, SAMPLE_ROWS = 4096, 1024, 1 << 17, 4096


def singles(width: int) -> list[int]:
    """How many leading components stand by themselves at each level."""
    return sorted({min(width, math.ceil(share * width)) for share in LEVELS})


def rest_of(y: np.ndarray, lead: int, segments: int = REST) -> np.ndarray:
    """Means and deviations of equal segments of what follows the ``lead`` first components.

    Scaled by the root of a segment's length, so that a plain inner product bounds that of the segments.
    """
    width = y.shape[1] - lead
    if not width:
        return np.zeros((len(y), 0))
    edges = lead + np.unique(np.linspace(0, width, min(segments, width) + 1).astype(int))
    parts = [y[:, a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return np.concatenate([np.stack([f(p, axis=1) * np.sqrt(p.shape[1]) for p in parts], 1) for f in (np.mean, np.std)], 1)


def basis_of(sample: np.ndarray, width: int) -> np.ndarray:
    """An orthogonal basis with the sample's directions of largest spread first."""
    if not len(sample):
        return np.eye(width)
    scale = max(1.0, float(np.abs(sample).max()))
    return np.linalg.eigh((sample / scale).T @ (sample / scale))[1][:, ::-1]


class Rows:
    """A block of vectors with what the bounds need of them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, basis: np.ndarray):
        self.ids, self.x = ids, x
        self.y = x @ basis
        self.rest = [rest_of(self.y, m) for m in singles(x.shape[1])]
        self.norm = float(np.sqrt((x * x).sum(1).max(initial=0.0)))


class Best:
    """The k best candidates so far of each query of a block; ``floor`` is a score that k candidates reach.

    ``pairs`` counts the pairs looked at and those that remain after each level; the last were scored.
    """

    def __init__(self, queries: Rows, k: int, floor: np.ndarray | None = None):
        self.q, self.k = queries, k
        n = len(queries.ids)
        self.floor = np.full(n, -np.inf) if floor is None else floor.copy()
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.pairs = np.zeros(len(queries.rest) + 1, np.int64)

    def remaining(self, c: Rows) -> tuple[np.ndarray, np.ndarray]:
        """(query, candidate) of the pairs that all levels leave."""
        q, levels = self.q, singles(self.q.x.shape[1])
        slack = 1e-9 * (1 + q.norm * c.norm)
        rows, cols = np.arange(len(q.ids)), np.arange(len(c.ids))
        part, done, alive = np.zeros((len(rows), len(cols))), 0, q.ids[:, None] != c.ids[None, :]
        self.pairs[0] += alive.sum()
        for i, m in enumerate(levels):
            part += q.y[rows, done:m] @ c.y[cols, done:m].T
            bound = part + q.rest[i][rows] @ c.rest[i][cols].T
            alive &= bound >= (self.floor[rows] - slack)[:, None]
            self.pairs[i + 1] += alive.sum()
            done = m
            r, s = alive.any(1), alive.any(0)
            if not (r.all() and s.all()):
                rows, cols, part, alive = rows[r], cols[s], part[r][:, s], alive[r][:, s]
        r, s = np.nonzero(alive)
        return rows[r], cols[s]

    def first_floor(self, c: Rows) -> None:
        """For queries without a threshold: the least score of k candidates that the coarsest bound puts first."""
        lacking = np.flatnonzero(~np.isfinite(self.floor))
        if not len(lacking) or len(c.ids) <= self.k:
            return
        m = singles(self.q.x.shape[1])[0]
        bound = self.q.y[lacking, :m] @ c.y[:, :m].T + self.q.rest[0][lacking] @ c.rest[0].T
        bound[self.q.ids[lacking, None] == c.ids[None, :]] = -np.inf
        likely = np.argpartition(-bound, self.k - 1, axis=1)[:, : self.k]
        score = np.einsum("qd,qkd->qk", self.q.x[lacking], c.x[likely])
        score[~np.isfinite(np.take_along_axis(bound, likely, 1))] = -np.inf
        self.floor[lacking] = score.min(1)

    def visit(self, c: Rows, step: int = 1 << 17) -> None:
        """Takes a block of candidates in."""
        self.first_floor(c)
        r, s = self.remaining(c)
        if not len(r):
            return
        score = np.concatenate([np.einsum("id,id->i", self.q.x[r[i : i + step]], c.x[s[i : i + step]]) for i in range(0, len(r), step)])
        own = score >= self.floor[r]
        row, found, score = np.concatenate([self.row, r[own]]), np.concatenate([self.id, c.ids[s[own]]]), np.concatenate([self.score, score[own]])
        order = np.lexsort((found, -score, row))
        row, found, score = row[order], found[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.row, self.id, self.score = row[keep], found[keep], score[keep]
        last = place == self.k - 1
        self.floor[row[last]] = np.maximum(self.floor[row[last]], score[last])

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.q.ids[self.row]), pa.array(self.id), pa.array(self.score)], names=["query_id", "vec_id", "score"])


def search(queries: DataFrame, candidates: DataFrame, k: int, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, slot_rows: int = SLOT_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query, itself excluded.

    Both tables have (vec_id, embedding), one row an id, all of one length.
    """
    spark = queries.sparkSession
    ship(spark)
    queries, candidates = cut(queries.select("vec_id", "embedding")), cut(candidates.select("vec_id", "embedding"))
    n, asked = candidates.count(), queries.count()
    t = bounded_sample(candidates, "vec_id", sample_rows).toArrow().sort_by("vec_id").combine_chunks()  # about sample_rows rows
    sample = (t["vec_id"].to_numpy(), matrix(t["embedding"].combine_chunks() if len(t) else pa.array([], pa.list_(pa.float64()))))
    shared = spark.sparkContext.broadcast((*sample, basis_of(sample[1], sample[1].shape[1]) if len(sample[0]) else None))
    in_blocks = lambda df, rows, size: blocks(df.coalesce(max(1, -(-rows // size))), size)
    c = cut(in_blocks(candidates, n, block_rows))
    slots = max(-(-n // slot_rows), min(max(1, c.count()), 2 * spark.sparkContext.defaultParallelism))

    def basis(width: int) -> np.ndarray:
        known = shared.value[2]
        return np.eye(width) if known is None else known

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, _ = shared.value
        for b in batches:
            floors = []
            for i in range(b.num_rows):
                own, q = unpack(b.column("ids")[i].as_py(), b.column("data")[i].as_py())
                floor = np.full(len(own), -np.inf)
                if len(ids) > k:
                    score = q @ x.T
                    score[own[:, None] == ids[None, :]] = -np.inf
                    floor = -np.partition(-score, k - 1, axis=1)[:, k - 1]
                    floor -= 1e-9 * (1 + np.abs(floor))
                floors.append(floor.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("ids"), b.column("data"), pa.array(floors, pa.binary())], names=["block", "ids", "data", "floor"])

    q = cut(in_blocks(queries, asked, query_rows).mapInArrow(thresholds, "block long, ids binary, data binary, floor binary"))
    every = F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))
    # a block's number, whichever task made it: tasks deal their blocks to slots in turn
    at = F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(0xFFFFFFFF) * max(1, -(-n // block_rows)), F.lit(slots)).cast("int")
    rows = c.select(at.alias("slot"), F.lit(0).alias("side"), "block", "ids", "data", F.lit(None).cast("binary").alias("floor"))
    rows = rows.unionByName(q.select(every.alias("slot"), F.lit(1).alias("side"), "block", "ids", "data", "floor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held = None, []
        for b in batches:
            for i in range(b.num_rows):
                if b.column("slot")[i].as_py() != slot:
                    slot, held = b.column("slot")[i].as_py(), []
                ids, x = unpack(b.column("ids")[i].as_py(), b.column("data")[i].as_py())
                own = Rows(ids, x, basis(x.shape[1]))
                if b.column("side")[i].as_py() == 0:
                    held.append(own)
                    continue
                best = Best(own, k, np.frombuffer(b.column("floor")[i].as_py(), "<f8"))
                for block in held:
                    best.visit(block)
                yield best.batch()

    found = rows.repartition(slots, "slot").sortWithinPartitions("slot", "side", "block").mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """Each component x as floor(scale * x), x as double."""
    return vectors.withColumn("embedding", F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(usable(table(spark, sf_dir, "embeddings"), zero=True))
    return search(vectors.filter("vec_id % 20 = 0"), vectors, 20).withColumn("score", F.col("score").cast("long"))


QUERIES = {"op10_topk": op10_topk}
ORACLES: dict[str, str] = {
    "op10_topk": """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query_id, rank, vec_id, score FROM (
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    WHERE rank <= 20
    """
}
