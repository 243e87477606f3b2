"""Telemetry reports: percentiles, shares, runs and composite scores over event rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import stats as S
from tessera.sources.folders import cut
from tessera.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def q1_pipeline_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per category: count, mean, nearest-rank percentiles, extremes, share of the total and rank by mean."""
    stats = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("value").alias("n"), F.avg("value").alias("avg_value"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.sum("value").alias("total"),
    )
    everything = Window.partitionBy(F.lit(1))
    return stats.select(
        "event_type", "n", F.round("avg_value", 6).alias("avg_value"), "p50", "p95", "min_value", "max_value",
        F.round(F.col("total") / F.sum("total").over(everything), 6).alias("share"),
        F.row_number().over(everything.orderBy(F.desc("avg_value"), "event_type")).alias("bottleneck_rank"),
    )


QUERIES["q1_pipeline_baseline"] = q1_pipeline_baseline
ORACLES["q1_pipeline_baseline"] = """
WITH s AS (SELECT event_type, count(value) AS n, avg(value) AS a, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95,
  min(value) AS min_value, max(value) AS max_value, sum(value) AS total FROM events GROUP BY event_type)
SELECT event_type, n, round(a, 6) AS avg_value, p50, p95, min_value, max_value, round(total / sum(total) OVER (), 6) AS share,
  CAST(row_number() OVER (ORDER BY a DESC, event_type) AS INTEGER) AS bottleneck_rank FROM s
"""


def a11_exact_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank p50, p95 and p99 of prices; a class holds up to half of all lines, and no task holds its values."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    return S.selected(lines, "l_returnflag", "l_extendedprice", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, cut)


QUERIES["a11_exact_percentiles"] = a11_exact_percentiles
ORACLES["a11_exact_percentiles"] = """
SELECT l_returnflag, CAST(quantile_disc(l_extendedprice, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(l_extendedprice, 0.95) AS DOUBLE) AS p95, CAST(quantile_disc(l_extendedprice, 0.99) AS DOUBLE) AS p99 FROM lineitem GROUP BY l_returnflag
"""
