"""Series held in arrays: advantages of an episode, weights of spans. Series of rows are in ``scan``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def advantages(rewards: Column, values: Column, gamma: float = 0.99, lam: float = 0.95) -> Column:
    """Generalised advantages of an episode: a scan from its end over arrays."""
    n = F.size(rewards)
    at = lambda a, i: F.get(a, i)
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(0.0).alias("adv"))

    def step(acc: Column, k: Column) -> Column:
        i = n - 1 - k
        delta = at(rewards, i) + gamma * F.coalesce(at(values, i + 1), F.lit(0.0)) - at(values, i)
        a = delta + gamma * lam * acc["adv"]
        return F.struct(F.concat(F.array(a), acc["out"]).alias("out"), a.alias("adv"))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), start, step)["out"]).otherwise(F.array().cast("array<double>"))


def span_weights(ids: Column, begin: int, end: int, weight: float) -> Column:
    """``weight`` for ids from a begin mark through its end mark, 1 for others."""
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(False).alias("inside"))

    def step(acc: Column, x: Column) -> Column:
        inside = acc["inside"] | (x == begin)
        return F.struct(F.concat(acc["out"], F.array(F.when(inside, F.lit(weight)).otherwise(F.lit(1.0)))).alias("out"), (inside & (x != end)).alias("inside"))

    return F.aggregate(ids, start, step)["out"]
