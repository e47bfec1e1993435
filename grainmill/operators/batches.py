"""Batches of rows of like length, padded, with masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators.scan import COUNT, scanned


def length_batches(df: DataFrame, by: str, length: str, order: list[str], rows: int) -> DataFrame:
    """``df`` with the number of the row's batch in its group ``by`` and the batch's width, its largest length.

    Groups go from long to short, ties in ``order``, which must be unique. Places in a group are counted over
    ranges, so a large group is no single task; ``df`` is written to the shared folder in between.
    """
    place = F.struct((-F.col(length)).alias("down"), *[F.col(c) for c in order])
    placed = scanned(df, by, place, [], COUNT).withColumn("batch", F.floor((F.col("step") - 1) / rows)).drop("step")
    width = placed.groupBy(F.col(by).alias("_by"), F.col("batch").alias("_batch")).agg(F.max(length).alias("width"))
    return placed.join(width, F.col(by).eqNullSafe(F.col("_by")) & (F.col("batch") == F.col("_batch"))).drop("_by", "_batch")


def padded(ids: Column, width: Column, pad: int) -> tuple[Column, Column]:
    """Ids filled up to the width, and the mask: 1 for an id, 0 for what was filled up."""
    fill = (width - F.size(ids)).cast("int")
    return F.concat(ids, F.array_repeat(F.lit(pad), fill)), F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), fill))
