"""The shared folder, and tables cut and kept in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a local session gets one of its own; a cluster fails, as its executors share no
    other folder that is known here.
    """
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        return folder.get()
    name = spark.conf.get("spark.checkpoint.dir", None)
    if not name:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        name = tempfile.mkdtemp(prefix="grainmill-checkpoints-")
    spark.sparkContext.setCheckpointDir(name)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_scopes: list[list[str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared checkpoint folder and cuts its lineage."""
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if _scopes and (file := checkpoint_file(out)):
        _scopes[-1].append(file)
    return out


def checkpoint_file(df: DataFrame) -> str | None:
    """Where the rows of a table that ``cut`` gave are."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    return file.get() if file.isDefined() else None


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what is cut inside at the end, when its results have been written."""
    _scopes.append([])
    try:
        yield
    finally:
        for file in _scopes.pop():
            delete(spark, file)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder below the shared folder, if it is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_cut(df: DataFrame) -> None:
    """Deletes the files of a table that ``cut`` gave; neither it nor what is built on it can be read any more."""
    if file := checkpoint_file(df):
        delete(df.sparkSession, file)


@contextmanager
def shared_table(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as a table written to the shared checkpoint folder, deleted at the end.

    What is computed from it and is used later must have been cut at a checkpoint inside.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        delete(spark, path)
