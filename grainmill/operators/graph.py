"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.checkpoints import cut, drop_cut
from grainmill.operators.skew import join_counted
from grainmill.shipping import ship


def smallest_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges (u, v): each node's smallest node reachable."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces a task's edges, some millions at a time, by stars of their components."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = nodes[smallest_labels(len(nodes), at[: len(u)], at[len(u) :])]
        own = root != nodes
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(root[own])], names=["u", "v"])

    for b in batches:
        held.append((b.column("u").to_numpy(zero_copy_only=False), b.column("v").to_numpy(zero_copy_only=False)))
        if sum(len(x[0]) for x in held) > 2_000_000:
            yield out()
    if held:
        yield out()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long): root is the smallest node of its component.

    Alternates large-star and small-star steps until the edges are stars; tasks first contract the edges
    they hold, and hubs' edges aren't shuffled by node. Each round is cut at a checkpoint, and the one before it deleted.
    """
    ship(edges.sparkSession)
    e = cut(edges.filter("u <> v").select("u", "v").mapInArrow(_contract, "u long, v long").distinct())
    last = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        large = join_counted(both.filter("v > u"), least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = cut(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        low = cut(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = join_counted(down, low, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        new = cut(small.mapInArrow(_contract, "u long, v long").distinct())
        for x in (e, least, down, low):
            drop_cut(x)
        e = new
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
