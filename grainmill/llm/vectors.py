"""Vectors that take part in a search, packed into blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.shipping import ship


def usable(df: DataFrame, zero: bool, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the vectors that take part, one for each id.

    Vectors that are null, empty, or hold a null or non-finite component take no part, and zero vectors
    only if ``zero``; of rows that share an id the least vector stands; of vectors of several lengths
    those of the most frequent (of equals, the shortest) take part.
    """
    v = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("embedding")).filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    v = v.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    if not zero:
        v = v.filter(F.exists("embedding", lambda x: x != 0))
    lengths = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if lengths:
        v = v.filter(F.size("embedding") == lengths[0]["n"])
    return v.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, all of one length, as float64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """(block, n, ids, data): up to ``rows`` vectors of a task as packed int64 ids and float64 components."""
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, ids, data, held = TaskContext.get().partitionId(), 0, [], [], 0

        def out() -> pa.RecordBatch:
            i, d = np.concatenate(ids), np.concatenate(data)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made]), pa.array([len(i)]), pa.array([i.astype("<i8").tobytes()], pa.binary()), pa.array([d.astype("<f8").tobytes()], pa.binary())], names=["block", "n", "ids", "data"])

        for b in batches:
            i, d = b.column("vec_id").to_numpy(zero_copy_only=False), matrix(b.column("embedding"))
            at = 0
            while at < len(i):
                take = min(rows - held, len(i) - at)
                ids.append(i[at : at + take])
                data.append(d[at : at + take])
                held, at = held + take, at + take
                if held == rows:
                    yield out()
                    made, ids, data, held = made + 1, [], [], 0
        if held:
            yield out()

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "block long, n long, ids binary, data binary")


def unpack(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(data, "<f8").reshape(len(i), -1)
