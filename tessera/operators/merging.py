"""Merges of changes into a target table, as whole new versions of it: a target is never changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, changes: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """The target after ``changes`` (at most one row a key): rows of new keys are added, and a column of ``values`` takes its
    expression over both versions, ``t.column`` and ``c.column`` (null where there is none)."""
    joined = target.alias("t").join(changes.alias("c"), F.col(f"t.{key}") == F.col(f"c.{key}"), "full")
    kept = [c for c in target.columns if c != key and c not in values]
    return joined.select(F.coalesce(f"t.{key}", f"c.{key}").alias(key), *(F.col(f"t.{c}") for c in kept), *(v.alias(c) for c, v in values.items()))


def delete(target: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The target without the rows whose key is in ``gone``."""
    return target.join(gone.select(key), key, "left_anti")


def null_out(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The child rows, with a null where their key is in ``gone``."""
    lost = gone.select(F.col(key), F.lit(True).alias("_gone")).distinct()
    return child.join(lost, key, "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def claim(rows: DataFrame, claims: DataFrame, key: str, state: str, wanted: str, taken: str) -> DataFrame:
    """Compare and set: of the claims (key, worker, at) on a row in state ``wanted`` the earliest takes it; claims on rows in another
    state are lost. The rows with state, worker and attempt, which goes up with each successful claim."""
    first = claims.groupBy(key).agg(F.min(F.struct("at", "worker")).alias("_c"))
    won = (F.col(state) == wanted) & F.col("_c").isNotNull()
    out = rows.join(first, key, "left").withColumn("worker", F.when(won, F.col("_c.worker"))).withColumn("attempt", F.col("attempt") + won.cast("int"))
    return out.withColumn(state, F.when(F.col("worker").isNotNull(), taken).otherwise(F.col(state))).drop("_c")
