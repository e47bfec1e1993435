"""Joins with a side of one row a key, where some keys of the other side have very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_counted(rows: DataFrame, side: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` joined with ``side`` on ``key``; ``side`` has one row a key, and ``count`` is the key's number of rows.

    Keys with more than two tasks' share of the rows, of which there are fewer than half as many as tasks, are
    broadcast, so their rows stay where they are; the others are shuffled. ``side`` is read three times: cut it
    first. ``count`` isn't among the result's columns.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = side.agg(F.sum(count).alias("n")).first().n or 0
    often = F.col(count) > max(1, 2 * total / tasks)
    hot = F.broadcast(side.filter(often).drop(count))
    rest = rows.join(hot.select(key), key, "left_anti").join(side.filter(~often).drop(count), key)
    return rows.join(hot, key).unionByName(rest)
