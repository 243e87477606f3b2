"""Ranking: weighted signals, deterministic winners, capped top-k and apportionment."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted(signals: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of the signals at hand: the weight of a null one goes to the others; null without any."""
    present = reduce(add, [F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in signals.values()])
    total = reduce(add, [F.coalesce(c, F.lit(0.0)) * w for c, w in signals.values()])
    return F.when(present > 0, total / present)


def redistributed(base: list[tuple[Column, float]], optional: list[tuple[Column, float]]) -> Column:
    """Weighted sum of signals: a missing base signal counts 0; the weights of missing optional ones go to the base ones in proportion."""
    total = sum(w for _, w in base)
    absent = reduce(add, [F.when(c.isNull(), w).otherwise(0.0) for c, w in optional])
    both = [reduce(add, [w * F.coalesce(c, F.lit(0.0)) for c, w in part]) for part in (base, optional)]
    return both[0] * (1 + absent / total) + both[1]


def tier(score: Column) -> Column:
    """Confidence tier of a score from 0 to 100."""
    return F.when(score >= 85, "high").when(score >= 70, "medium").when(score >= 50, "low").otherwise("none")


def winners(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("place = 1").drop("place")


def top(df: DataFrame, key: str, order: list[Column], k: int, name: str = "place") -> DataFrame:
    """The first ``k`` rows of each key in order, with their place from 1. Spark cuts each partition to ``k`` rows a key before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(name) <= k).withColumn(name, F.col(name).cast("long"))


def capped_top(df: DataFrame, key: str, part: str, order: list[Column], cap: int, total: int) -> DataFrame:
    """At most ``cap`` rows of each part and ``total`` rows of each key, in order, with their place."""
    capped = df.withColumn("in_part", F.row_number().over(Window.partitionBy(key, part).orderBy(*order))).where(F.col("in_part") <= cap)
    return capped.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= total)


def apportion(df: DataFrame, weight: str, name: str, seats: int) -> DataFrame:
    """Seats by largest remainder. ``df`` has a row for each name (a closed set of few)."""
    everything = Window.partitionBy(F.lit(1))
    quota = F.col(weight) * seats / F.sum(weight).over(everything)
    rows = df.withColumn("quota", quota).withColumn("floor", F.floor("quota").cast("long"))
    left = F.lit(seats) - F.sum("floor").over(everything)
    place = F.row_number().over(everything.orderBy(F.desc(F.round(F.col("quota") - F.col("floor"), 9)), name))
    return rows.withColumns({"left": left, "place": place}).select(name, (F.col("floor") + (F.col("place") <= F.col("left")).cast("long")).alias("seats"))


def gaussian(value: Column, target: float, sigma: float) -> Column:
    """1 at the target, falling with the square of the distance."""
    return F.exp(-((value - target) * (value - target)) / (2 * sigma * sigma))


def interpolate(x: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear through ascending points, constant beyond both ends; null stays null."""
    out = F.when(x.isNull(), F.lit(None)).when(x <= points[0][0], float(points[0][1]))
    for (x1, y1), (x2, y2) in zip(points, points[1:]):
        out = out.when(x <= x2, y1 + (x - x1) * ((y2 - y1) / (x2 - x1)))
    return out.otherwise(float(points[-1][1]))
