"""Token files on disk as a data source: written in two phases, read by ranges.

The folder must be one that the driver and all executors see. A task writes below a folder of the write's own;
what the job commits is moved to its place by the driver, the rest goes with that folder. So a failed task, a
lost executor or a second attempt leaves nothing. A file is read by as many tasks as it has ranges.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from grainmill.shipping import ship
from grainmill.sources.readers import HEADER, MAGIC, token_header

#: Ids that a task reads, and that a batch or an array of its result holds.
RANGE_IDS, ARRAY_IDS = 1 << 24, 1 << 16


@dataclass
class Written(WriterCommitMessage):
    name: str | None


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int
    vocabulary: int


def described(path: str) -> dict:
    """The description in a file's header; fails if the magic word or the size is wrong."""
    with open(path, "rb") as f:
        head = f.read(HEADER)
    size = os.path.getsize(path) - HEADER
    if head[: len(MAGIC)] != MAGIC or len(head) < HEADER:
        raise ValueError(f"{path} is no token file")
    about = json.loads(head[len(MAGIC) :].rstrip(b"\0"))
    if size != 4 * about["count"]:
        raise ValueError(f"{path} holds {size} bytes of ids, not {4 * about['count']}")
    return about


class Reader(DataSourceReader):
    def __init__(self, path: str, ids: int):
        self.path, self.ids = path, ids

    def partitions(self) -> list[Range]:
        names = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(self.path, n) for n in os.listdir(self.path) if n.endswith(".bin"))
        out = []
        for n in names:
            about = described(n)
            out += [Range(n, i, min(about["count"], i + self.ids), about["vocab"]) for i in range(0, about["count"], self.ids)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition:
            return
        with open(partition.path, "rb") as f:
            f.seek(HEADER + 4 * partition.start)
            for start in range(partition.start, partition.stop, ARRAY_IDS):
                n = min(ARRAY_IDS, partition.stop - start)
                ids = np.frombuffer(f.read(4 * n), "<u4")
                if len(ids) != n or (n and int(ids.max()) >= partition.vocabulary):
                    raise ValueError(f"{partition.path}: ids from {start} are cut off or outside the vocabulary")
                arrays = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([start], pa.int64()), arrays], names=["path", "start", "ids"])


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, vocabulary: int, overwrite: bool):
        self.path, self.vocabulary, self.overwrite = path, vocabulary, overwrite
        self.run = uuid.uuid4().hex
        self.held = os.path.join(path, f".writing-{self.run}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One file for the rows of a task, in their order; an id outside the vocabulary fails it. No file without rows."""
        task = TaskContext.get()
        name, count = f"part-{task.partitionId():05d}-{self.run[:8]}.bin", 0
        os.makedirs(self.held, exist_ok=True)
        path = os.path.join(self.held, f"{task.taskAttemptId()}-{name}")
        with open(path, "wb") as f:
            f.write(token_header(0, self.vocabulary))
            for b in iterator:
                ids = b.column(0).flatten().to_numpy(zero_copy_only=False)
                if len(ids) and (ids.min() < 0 or ids.max() >= self.vocabulary):
                    raise ValueError(f"an id is outside the vocabulary of {self.vocabulary}")
                f.write(ids.astype("<u4").tobytes())
                count += len(ids)
            f.seek(0)
            f.write(token_header(count, self.vocabulary))
        return Written(os.path.basename(path) if count else None)

    def commit(self, messages: list[Written | None]) -> None:
        old = [os.path.join(self.path, n) for n in os.listdir(self.path) if n.endswith(".bin")] if self.overwrite and os.path.isdir(self.path) else []
        os.makedirs(self.path, exist_ok=True)
        for m in messages:
            if m and m.name:
                os.replace(os.path.join(self.held, m.name), os.path.join(self.path, m.name.partition("-")[2]))
        for n in old:
            os.remove(n)
        shutil.rmtree(self.held, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.held, ignore_errors=True)


class TokenFiles(DataSource):
    """Format ``tokens``. Options: path; ``vocabulary`` to write, ``ids`` for the ids of a range to read."""

    @classmethod
    def name(cls) -> str:
        return "tokens"

    def schema(self) -> str:
        return "path string, start long, ids array<long>"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], int(self.options.get("ids", RANGE_IDS)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options["vocabulary"]), overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(TokenFiles)


def token_export(ids: DataFrame, path: str, vocabulary: int, order: str = "doc_id", column: str = "ids") -> None:
    """K6: token files, one for each task's range of the order; their names are in that order. Null arrays hold no ids."""
    register(ids.sparkSession)
    ranged = ids.filter(F.col(column).isNotNull()).select(order, F.col(column).cast("array<long>").alias("ids")).repartitionByRange(order).sortWithinPartitions(order)
    ranged.select("ids").write.format("tokens").option("vocabulary", vocabulary).mode("overwrite").save(path)


def token_ranges(spark: SparkSession, path: str, ids: int = RANGE_IDS) -> DataFrame:
    """(path, start, ids) of a token file or a folder of them: arrays of up to 65,536 ids with the place of the first."""
    register(spark)
    return spark.read.format("tokens").option("ids", ids).load(path)
