"""Readers for the star-schema and corpus tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (any URI that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
