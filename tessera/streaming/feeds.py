"""Streams of event rows (event_id, ts, user_id, event_type): rate limits, change feeds and idempotent intake.

A key's rows of one micro-batch are taken in the order of (ts, event_id); rows of a later batch come after them. A micro-batch's
rows of one key are held by one task, so that the source's ``maxFilesPerTrigger`` bounds its memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    """A stream of a folder's Parquet files, ``files`` at a time."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def drained(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """What the stream gives for all input at hand; run again with the same checkpoint, it goes on with new files only."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")


def rate_limited(stream: DataFrame, key: str, seconds: int, most: int) -> DataFrame:
    """event_id, allowed: at most ``most`` rows of a key in a window that begins with its first row after the window before."""

    def step(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        rows, allowed = _in_order(batches), []
        for at in rows["ts"].to_numpy("datetime64[us]").astype("int64").tolist():
            if start is None or at - start >= seconds * 1_000_000:
                start, n = at, 0
            n += 1
            allowed.append(n <= most)
        state.update((start, n))
        yield pd.DataFrame({"event_id": rows["event_id"], "allowed": allowed})

    rows = stream.select(key, "event_id", "ts").where("ts IS NOT NULL")
    return rows.groupBy(key).applyInPandasWithState(step, "event_id long, allowed boolean", "start long, n long", "append", GroupStateTimeout.NoTimeout)


def changes(stream: DataFrame, key: str, payload: str) -> DataFrame:
    """event_id of the rows whose payload differs from the one before of their key; null is a payload like others."""

    def step(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last = (True, state.get[0]) if state.exists else (False, None)
        out = []
        for event_id, value in _in_order(batches)[["event_id", payload]].itertuples(index=False, name=None):
            value = None if pd.isna(value) else value
            if not seen or value != last:
                out.append(event_id)
            seen, last = True, value
        state.update((last,))
        yield pd.DataFrame({"event_id": pd.Series(out, dtype="int64")})

    rows = stream.select(key, "event_id", "ts", payload)
    return rows.groupBy(key).applyInPandasWithState(step, "event_id long", "last string", "append", GroupStateTimeout.NoTimeout)


def once(stream: DataFrame, job: str, delay: str) -> DataFrame:
    """Idempotent intake: a job id's first row within the watermark's delay."""
    return stream.withColumn("ts", stream["ts"].cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark([job])
