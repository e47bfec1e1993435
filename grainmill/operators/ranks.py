"""Running totals, global places and exact numbers of least rows, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.checkpoints import cut


def running_totals(df: DataFrame, order: list[str], value: Column, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows that come before in ``order``, which must be unique.

    Rows are dealt to tasks by ranges of the order; each task sums its own, and what stands before it is the
    sum of the earlier tasks' totals, one row a task. The table is written to the shared folder in between,
    so it should hold keys and sizes, not texts.
    """
    ranged = df.withColumn("_v", value).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumn("_part", F.spark_partition_id()))
    by_part = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.sum("_v").alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(by_part), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_offset") + F.coalesce(F.sum("_v").over(within), F.lit(0))
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, total).drop("_v", "_part", "_offset")


def places(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """``df`` with each row's place, from 0, in ``order``."""
    return running_totals(df, order, F.lit(1).cast("long"), name)


def least_hashed(df: DataFrame, k: int, seed: int, key: str, bits: int = 16) -> DataFrame:
    """The ``k`` rows of the least seeded hashes of ``key`` (ties by key).

    A histogram of the hashes' leading bits says which rows are in whatever the order of the rest; only the
    rows of one bucket, of ``1 / 2**bits`` of all, are sorted.
    """
    h = F.xxhash64(key, F.lit(seed))
    x = df.withColumn("_h", h).withColumn("_b", F.shiftright("_h", 64 - bits))
    before, edge = 0, None
    for r in x.groupBy("_b").count().orderBy("_b").collect():  # at most 2**bits rows
        if before + r["count"] > k:
            edge = r["_b"]
            break
        before += r["count"]
    if edge is None:
        return df
    inside = x.filter(F.col("_b") < edge)
    rest = x.filter(F.col("_b") == edge).orderBy("_h", key).limit(k - before)
    return inside.unionByName(rest).drop("_h", "_b")
