"""Folders of JSON files in the shared scratch folder: files by key, lines, and append-only logs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one only where spark.checkpoint.dir is unset and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "rounds") -> DataFrame:
    """Written to the shared folder and read back, which ends the lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def json_lines(df: DataFrame) -> DataFrame:
    """The rows, written as JSON lines and read back with their schema."""
    path = scratch(df.sparkSession, "lines")
    df.write.json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def json_by_key(df: DataFrame, key: str, schema: str) -> DataFrame:
    """The rows, written to a folder for each key and read back with the key taken from the files' paths."""
    path = scratch(df.sparkSession, "by-key")
    df.write.partitionBy(key).json(path)
    files = df.sparkSession.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    return files.withColumn(key, F.regexp_extract(F.col("_metadata.file_path"), rf"{key}=([^/]+)/", 1))


def appended(parts: list[DataFrame]) -> DataFrame:
    """A log to which each part was appended in turn."""
    path, spark = scratch(parts[0].sparkSession, "log"), parts[0].sparkSession
    for part in parts:
        part.write.mode("append").parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)
