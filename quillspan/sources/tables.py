"""Readers of the parquet tables a query works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table `name` in `folder`, either a file or a directory of parts."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
