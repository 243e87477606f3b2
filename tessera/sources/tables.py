"""Readers of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; filters and column choices on it reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
