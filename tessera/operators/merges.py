"""Merges: patches of maps, unique slugs and the fair pick of a queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def patch(old: Column, new: Column) -> Column:
    """``old`` with the entries of ``new``; of a key in both, the new one stays. Null counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    new = F.coalesce(new, empty)
    return F.map_concat(F.map_filter(F.coalesce(old, empty), lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def unique_slugs(df: DataFrame, slug: str, order: str) -> DataFrame:
    """The first row of a slug keeps it, the next ones get -2, -3 and so on. One slug's rows are sorted in one task."""
    place = F.row_number().over(Window.partitionBy(slug).orderBy(order))
    return df.withColumn("place", place).withColumn(slug, F.when(F.col("place") > 1, F.concat_ws("-", slug, "place")).otherwise(F.col(slug))).drop("place")


def fair_pick(waiting: DataFrame, running: DataFrame, key: str, order: list[str], cap: int) -> DataFrame:
    """The first waiting row in order whose key has fewer than ``cap`` running rows."""
    full = running.groupBy(key).count().where(F.col("count") >= cap).select(key)
    return waiting.join(full, key, "left_anti").orderBy(*order).limit(1)
