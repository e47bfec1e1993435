"""Approximate nearest neighbours by NN-descent, searched greedily.

Equal vectors are one node. A node's first neighbours come from blocks of nodes that are near by random
projections. NN-descent then repeats: each node gathers a bounded number of its neighbours and of the nodes
that name it, all pairs among them with a new member are scored, and each node keeps its best. Both steps
are Spark joins by node; only nodes' names and one-byte components move.

A query, itself a node, walks the graph from its own neighbours (``walk`` takes other starts too): its best
nodes not yet expanded are expanded until none is left among its best, or ``steps`` times. The nodes it ends
with are scored exactly on the original vectors, and nodes are expanded to the ids that share the vector.

Every vector is indexed; nothing is fitted on a sample. Defined results: vectors that are null, empty, zero
or hold a null or non-finite component take no part; rows that share an id count once; ties go to the
smaller id; small tables, up to one block, are searched whole; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainmill.checkpoints import cut, drop_cut
from grainmill.llm.vectors import matrix, usable
from grainmill.operators.skew import join_counted
from grainmill.shipping import ship
from grainmill.tables import table


@dataclass(frozen=True)
class Params:
    """Neighbours kept, reverse neighbours used, nodes in a first block, projections, rounds; what a member gets from
    one neighbourhood in a round, at most; beam, expansions of a search step, and steps at most."""

    neighbours: int = 40
    reverse: int = 24
    block: int = 2048
    projections: int = 6
    rounds: int = 5
    given: int = 10
    beam: int = 120
    expand: int = 24
    steps: int = 6
    seed: int = 23


def top(df: DataFrame, key: str, k: int, order: list[Column]) -> DataFrame:
    """The first k rows of each key; tasks drop rows past their own first k before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def nodes_of(vectors: DataFrame, k: int) -> DataFrame:
    """(node, embedding, ids): one row for each distinct vector; ``ids`` are its k smallest ids, ``node`` the least."""
    ranked = vectors.withColumn("_r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).filter(F.col("_r") <= k)
    return ranked.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("node"), "embedding", "ids")


def packed(nodes: DataFrame) -> DataFrame:
    """(node, code): the vector in one-byte components, and the vector's own scale in four bytes more.

    Scales are shares of the table's largest component, so scores stay finite.
    """
    ship(nodes.sparkSession)
    widest = nodes.agg(F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))).alias("c")).first().c or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("embedding"))
            own = np.abs(x).max(1, keepdims=True, initial=0.0)
            own[own == 0] = 1.0
            code, scale = np.rint(x / own * 127).astype(np.int8), (own / widest / 127).astype("<f4")
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([c.tobytes() + s.tobytes() for c, s in zip(code, scale, strict=True)], pa.binary())], names=["node", "code"])

    return nodes.select("node", "embedding").mapInArrow(run, "node long, code binary")


def codes(column: pa.Array) -> np.ndarray:
    """Vectors of a column of codes, all of one length, as float32 rows."""
    raw = column.to_pylist()
    grid = np.frombuffer(b"".join(raw), np.int8).reshape(len(raw), -1 if raw else 4)
    return grid[:, :-4].astype(np.float32) * np.ascontiguousarray(grid[:, -4:]).view("<f4")


def best_of_rows(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest finite entries of each row."""
    k = min(k, score.shape[1])
    at = np.argpartition(-score, k - 1, axis=1)[:, :k]
    keep = np.isfinite(np.take_along_axis(score, at, 1))
    return np.nonzero(keep)[0], at[keep]


def first_edges(code: DataFrame, p: Params, blocks: int) -> DataFrame:
    """(u, v, score): each node's best among the nodes that share a block by a random projection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = np.array(b.column("ids")[i].as_py(), np.int64)
                x = codes(b.column("codes")[i].values)
                for a in range(0, len(ids), p.block):  # rows of a block beyond its size: in parts
                    score = x[a : a + p.block] @ x.T
                    score[np.arange(len(score)), a + np.arange(len(score))] = -np.inf
                    r, c = best_of_rows(score, p.neighbours)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a + r]), pa.array(ids[c]), pa.array(score[r, c])], names=["u", "v", "score"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = codes(b.column("code"))
            for t in range(p.projections):
                r = np.random.default_rng(p.seed + t)
                planes = r.standard_normal((max(1, blocks.bit_length() - 1), x.shape[1])).astype(np.float32)
                sign = (x @ planes.T > 0) @ (1 << np.arange(len(planes)))
                yield pa.RecordBatch.from_arrays([pa.array((sign.astype(np.int64) << 8) + t), b.column("node"), b.column("code")], names=["cell", "node", "code"])

    placed = code.mapInArrow(cells, "cell long, node long, code binary")
    sizes = placed.groupBy("cell").count()
    part = placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("node", F.lit(p.seed)), F.ceil(F.col("count") / p.block)))
    grouped = part.groupBy("cell", "part").agg(F.collect_list("node").alias("ids"), F.collect_list("code").alias("codes"))
    return grouped.select("ids", "codes").mapInArrow(run, "u long, v long, score float")


def merged(old: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """The k best edges of each node; an edge that was there before is not new."""
    both = old.withColumn("fresh", F.lit(0)).unionByName(new.withColumn("fresh", F.lit(1)))
    w = Window.partitionBy("u").orderBy(F.desc("score"), "v", "fresh")
    again = F.coalesce((F.lag("v").over(w) == F.col("v")) & (F.lag("score").over(w) == F.col("score")), F.lit(False))
    rank = F.sum((~F.col("again")).cast("int")).over(w)
    return both.withColumn("again", again).withColumn("rank", rank).filter(~F.col("again") & (F.col("rank") <= k)).select("u", "v", "score", "fresh")


def descend(edges: DataFrame, code: DataFrame, p: Params) -> DataFrame:
    """One round: pairs among each node's neighbours and reverse neighbours, scored; the best for each member."""
    ship(edges.sparkSession)
    floor = edges.groupBy("u").agg(F.min("score").alias("floor"), F.count("*").alias("n")).select(F.col("u").alias("m"), F.when(F.col("n") >= p.neighbours, F.col("floor")).otherwise(F.lit(float("-inf")).cast("float")).alias("floor"))
    back = top(edges.select(F.col("v").alias("u"), F.col("u").alias("m"), "fresh"), "u", p.reverse, [F.desc("fresh"), F.xxhash64("m", "u"), F.col("m")])
    gathered = edges.select("u", F.col("v").alias("m"), "fresh").unionByName(back).groupBy("u", "m").agg(F.max("fresh").alias("fresh"))
    known = code.join(floor, code["node"] == floor["m"], "left").select(F.col("node").alias("m"), "code", F.coalesce("floor", F.lit(float("-inf")).cast("float")).alias("floor"))
    rows = gathered.join(known, "m").repartition("u").sortWithinPartitions("u")

    def pairs(m: np.ndarray, fresh: np.ndarray, floor: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = x @ x.T
        score[~(fresh[:, None] | fresh[None, :]) | (m[:, None] == m[None, :])] = -np.inf
        score[score <= floor[:, None]] = -np.inf
        r, c = best_of_rows(score, p.given)
        return m[r], m[c], score[r, c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            a, b, s = (np.concatenate(x) for x in zip(*out, strict=True))
            out.clear()
            order = np.lexsort((b, -s, a))
            a, b, s = a[order], b[order], s[order]
            keep = np.ones(len(a), bool)
            keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            a, b, s = a[keep], b[keep], s[keep]
            start = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, int)
            place = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
            keep = place < p.neighbours
            return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(s[keep])], names=["u", "v", "score"])

        def groups() -> Iterator[tuple]:
            nonlocal held
            for batch in batches:
                part = (batch.column("u").to_numpy(), batch.column("m").to_numpy(), batch.column("fresh").to_numpy() > 0, batch.column("floor").to_numpy(), codes(batch.column("code")))
                if held is not None:
                    part = tuple(np.concatenate([h, q]) for h, q in zip(held, part, strict=True))
                edge = np.flatnonzero(part[0][1:] != part[0][:-1]) + 1
                bounds = [0, *edge.tolist()]
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    yield tuple(q[a:b] for q in part[1:])
                held = tuple(q[bounds[-1] :] for q in part)
            if held is not None:
                yield held[1:]

        for g in groups():
            if len(g[0]) > 1 and g[1].any():
                found = pairs(*g)
                out.append(found)
                size += len(found[0])
                if size > 400_000:
                    yield flush()
                    size = 0
        if out:
            yield flush()

    return rows.select("u", "m", "fresh", "floor", "code").mapInArrow(run, "u long, v long, score float")


def graph(code: DataFrame, p: Params = Params()) -> DataFrame:
    """(u, v, score): the neighbour graph of (node, code)."""
    n = code.count()
    edges = cut(merged(first_edges(code, p, 1 if n <= p.block else -(-2 * n // p.block)), first_edges(code, p, 1).limit(0), p.neighbours).withColumn("fresh", F.lit(1)))
    if n <= p.block:
        return edges.select("u", "v", "score")
    for _ in range(p.rounds):
        before, edges = edges, cut(merged(edges.select("u", "v", "score"), descend(edges, code, p), p.neighbours))
        drop_cut(before)
        if edges.filter("fresh = 1").count() < 0.005 * p.neighbours * n:
            break
    return edges.select("u", "v", "score")


def walk(queries: DataFrame, start: DataFrame, edges: DataFrame, code: DataFrame, p: Params = Params()) -> DataFrame:
    """(query, node): the best nodes each query ends with.

    ``queries`` has (query, q_code), ``start`` has (query, node): nodes to begin with.
    """
    ship(edges.sparkSession)
    links = edges.groupBy(F.col("u").alias("node")).agg(F.collect_list("v").alias("next"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.einsum("id,id->i", codes(b.column("q_code")), codes(b.column("code")))
            yield pa.RecordBatch.from_arrays([b.column("query"), b.column("node"), pa.array(score)], names=["query", "node", "score"])

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.join(code, "node").join(queries, "query").select("query", "q_code", "node", "code").mapInArrow(run, "query long, node long, score float")

    order = [F.desc("score"), F.col("node")]
    beam = cut(top(scored(start.distinct()).withColumn("done", F.lit(0)), "query", p.beam, order))
    for _ in range(p.steps):
        w = Window.partitionBy("query").orderBy("done", *order)
        picked = beam.withColumn("turn", (F.col("done") == 0) & (F.row_number().over(w) <= p.expand))
        before, picked = beam, cut(picked.withColumn("done", F.greatest("done", F.col("turn").cast("int"))))
        drop_cut(before)
        reached = picked.filter("turn").join(links, "node").select("query", F.explode("next").alias("node")).distinct()
        fresh = reached.join(picked.select("query", "node"), ["query", "node"], "left_anti")
        beam = cut(top(picked.drop("turn").unionByName(scored(fresh).withColumn("done", F.lit(0))), "query", p.beam, order))
        drop_cut(picked)
        if beam.filter("done = 0").isEmpty():
            break
    return beam.select("query", "node")


def named(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, node) of ``rows`` (vec_id, embedding); rows of a frequent vector aren't shuffled by it."""
    counts = rows.groupBy("embedding").agg(F.count("*").alias("n"))
    side = cut(nodes.select("node", "embedding").join(counts, "embedding"))
    return join_counted(rows, side, "embedding", "n").select(F.col("vec_id").alias("query_id"), "node")


def search(vectors: DataFrame, wanted: Column, k: int, p: Params = Params()) -> DataFrame:
    """(query_id, rank, vec_id, score): about the k largest inner products of the rows ``wanted`` picks, themselves excluded.

    ``vectors`` has (vec_id, embedding), one row an id, all of one length.
    """
    vectors = cut(vectors)
    nodes = cut(nodes_of(vectors, k + 1))
    code = cut(packed(nodes))
    edges = graph(code, p)
    asked = cut(named(vectors.filter(wanted), nodes))
    queries = asked.select(F.col("node").alias("query")).distinct().join(code.select(F.col("node").alias("query"), F.col("code").alias("q_code")), "query")
    queries = cut(queries)
    own = queries.select("query", F.col("query").alias("node"))
    begin = own.unionByName(edges.select(F.col("u").alias("query"), F.col("v").alias("node")).join(queries.select("query"), "query", "left_semi"))
    ends = walk(queries, begin, edges, code, p)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.einsum("id,id->i", matrix(b.column("q")), matrix(b.column("x")))
            yield pa.RecordBatch.from_arrays([b.column("query"), b.column("node"), pa.array(s)], names=["query", "node", "score"])

    x = nodes.select("node", F.col("embedding").alias("x"))
    q = nodes.select(F.col("node").alias("query"), F.col("embedding").alias("q")).join(queries.select("query"), "query", "left_semi")
    scores = ends.join(x, "node").join(q, "query").select("query", "node", "q", "x").mapInArrow(exact, "query long, node long, score double")
    best = top(scores, "query", k + 1, [F.desc("score"), F.col("node")])
    rows = asked.withColumnRenamed("node", "query").join(best, "query").join(nodes.select("node", "ids"), "node")
    rows = rows.select("query_id", F.explode("ids").alias("vec_id"), "score").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(usable(table(spark, sf_dir, "embeddings"), zero=False), F.col("vec_id") % 20 == 0, 20)


QUERIES = {"op3_ann": op3_ann}
ORACLES: dict[str, str] = {}
