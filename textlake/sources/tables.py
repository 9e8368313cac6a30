"""Stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Scan one Parquet table; filters and column lists reach the scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
