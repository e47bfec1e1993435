"""Replay of experiences by priority: what is kept within a capacity, and weighted samples of it.

An experience has (id, reward) and whatever else; its priority is the reward's size and a little, so that none is
never drawn. Places go by ranges of the order, so a capacity of any size is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators.ranks import places

ALPHA = 0.6


def priority(reward: Column) -> Column:
    """A null or NaN reward counts as 0."""
    return F.abs(F.coalesce(F.nanvl(reward.cast("double"), F.lit(0.0)), F.lit(0.0))) + F.lit(1e-6)


def least(df: DataFrame, n: int, by: Column, key: str = "id") -> DataFrame:
    """The ``n`` rows least in ``by``, ties by ``key``, which is unique; no other columns take part in the sort."""
    placed = places(df.select(F.col(key).alias("id"), by.alias("by")), ["by", "id"]).filter(F.col("place") < n)
    return df.join(placed.select(F.col("id").alias(key)), key, "left_semi")


def kept(df: DataFrame, capacity: int, key: str = "id") -> DataFrame:
    """The experiences of the largest priorities; of equal ones those with the smaller key."""
    return least(df, capacity, -priority(F.col("reward")), key)


def merged(old: DataFrame, new: DataFrame, capacity: int, key: str = "id") -> DataFrame:
    """What is kept of ``old`` after ``new``, whose experiences take the place of old ones with the same key.

    Keeping part by part and merging gives what keeping all at once does, as long as no key is given twice.
    """
    return kept(old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns)), capacity, key)


def draw(key: Column, weight: Column, seed: Column, alpha: float = ALPHA) -> Column:
    """An experience's key in a weighted draw without replacement: an exponential with the rate ``weight ** alpha``."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), key.cast("string"))), 1, 13), 16, 10).cast("long")
    return -F.log((u + 1) / F.lit(float(2**52 + 1))) / F.pow(weight, F.lit(alpha))


def sampled(df: DataFrame, n: int, seed: int, alpha: float = ALPHA, key: str = "id") -> DataFrame:
    """``n`` experiences drawn without replacement, in proportion to their priorities to the power ``alpha``; all, if fewer."""
    return least(df, n, draw(F.col(key), priority(F.col("reward")), F.lit(seed), alpha), key)
