"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; it may be a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
