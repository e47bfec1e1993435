"""Writers of corpus files; Spark's committer makes each write whole or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.checkpoints import delete
from grainmill.operators.ranks import places
from grainmill.sources.readers import budgeted


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """K1, K3"""
    df.write.mode("append" if append else "overwrite").json(path)


def transcript(pairs: DataFrame) -> DataFrame:
    """K2: one block of text for each pair; blank pairs go."""
    p, c = F.trim("prompt"), F.trim("completion")
    return pairs.filter((p != "") & (c != "")).select(F.format_string("User: %s\n\nAssistant: %s\n", p, c).alias("value"))


def write_transcript(pairs: DataFrame, path: str) -> None:
    transcript(pairs).write.mode("overwrite").text(path)


def corpus(df: DataFrame, path: str, by: str = "source") -> None:
    """K4: the combined corpus, partitioned by source."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def batches(df: DataFrame, path: str, rows: int) -> None:
    """K5: files of at most ``rows`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def append_checked(df: DataFrame, path: str, expected: int) -> int:
    """K7: appends if the table holds ``expected`` rows; a failed or incomplete write is taken back.

    An append writes new files only, so taking it back deletes the files that weren't there before.
    """
    spark = df.sparkSession
    have = spark.read.parquet(path).count()
    if have != expected:
        raise ValueError(f"the table holds {have} rows, not {expected}")
    before, new = files_of(spark, path), df.count()
    try:
        df.write.mode("append").parquet(path)
        total = spark.read.parquet(path).count()
        if total != have + new:
            raise ValueError(f"the table holds {total} rows after the append, not {have + new}")
    except Exception:
        for file in files_of(spark, path) - before:
            delete(spark, file)
        raise
    return total


def files_of(spark: SparkSession, path: str) -> set[str]:
    """Data files right below ``path``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return {str(f.getPath()) for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p) if f.getPath().getName().startswith("part-")}


def byte_batches(df: DataFrame, path: str, order: str, batch: int = 5 << 20, text: str = "text") -> None:
    """K5: one folder for each ``batch`` bytes of text, in order."""
    budgeted(df, 1 << 62, order, batch, text).write.mode("overwrite").partitionBy("file").parquet(path)


def indexed(df: DataFrame, path: str, order: str, buckets: int = 64) -> None:
    """K9: sequences with their places; rows of a range of places lie together, so that few files are read for few places."""
    numbered = df.join(places(df.select(order), [order]), order)
    numbered.repartitionByRange(buckets, "place").sortWithinPartitions("place").write.mode("overwrite").parquet(path)


def at_places(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """K9: the sequences at the places ``wanted`` (pos, place), with ``pos`` to order them by; a place may come twice."""
    return wanted.select("pos", "place").join(spark.read.parquet(path), "place")
