"""Parquet table source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Scan one table of a dataset directory; column pruning and filters reach the parquet reader."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
