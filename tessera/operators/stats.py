"""Aggregations and windows over telemetry rows: shares, spread, entropy, runs and rolling statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def normalised_entropy(df: DataFrame, key: str) -> DataFrame:
    """classes and the Shannon entropy of ``key`` over log2(max(2, classes))."""
    counts = df.groupBy(key).count()
    total = df.agg(F.count(F.lit(1)).alias("total"))  # one row
    p = F.col("count") / F.col("total")
    out = counts.crossJoin(F.broadcast(total)).agg(F.count(F.lit(1)).alias("classes"), (-F.sum(p * F.log2(p))).alias("h"))
    return out.select("classes", F.round(F.col("h") / F.log2(F.greatest(F.lit(2), "classes")), 6).alias("entropy"))


def spread(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: count, mean, population deviation and coefficient of variation."""
    out = df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return out.select(key, "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round(ratio(F.col("sd"), F.col("mean")), 6).alias("cv"))


def mode_first_seen(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most common value per key; among equals the one seen first."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = counts.groupBy(key).agg(F.max(F.struct("n", (-F.col("first")).alias("f"), F.col(value).alias("v"))).alias("m"))
    return best.select(key, F.col("m.v").alias("mode"), F.col("m.n").alias("n"))


def runs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Runs of equal consecutive values: key, run, value, length."""
    by = Window.partitionBy(key).orderBy(*order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(by))) | (F.row_number().over(by) == 1)
    rows = df.select(key, *order, value, change.cast("int").alias("new"))
    rows = rows.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("length"))


def selected(df: DataFrame, key: str, value: str, shares: dict[str, float], cut) -> DataFrame:
    """key and, by the names of ``shares``, its nearest-rank percentiles (the ``ceil(share * n)``-th smallest value): exact, and without
    a key's values in one task.

    A value's bin is its sign, exponent and first bits of the mantissa, which follow the order of the values. Bins are counted, the one
    with the wanted rank is found from the counts, and its rows alone are counted again by 12 further bits, until all 48 are known;
    what is left of a key and share are the few values that differ beyond them. Null is passed over; NaN is the greatest.
    """
    v = F.col("_v")
    exponent = F.floor(F.log2(F.abs(v)))
    mantissa = F.abs(v) / F.pow(F.lit(2.0), exponent) - 1

    def bin_at(bits: int) -> Column:
        plain = (exponent + 1100) * (1 << bits) + F.floor(mantissa * float(1 << bits))
        return F.when(F.isnan(v), F.lit((1 << 62) + 1)).when(v == 0, F.lit(0)).when(F.abs(v) == float("inf"), F.signum(v).cast("long") * (1 << 62)).otherwise(F.signum(v).cast("long") * plain)

    rows = df.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    by = Window.partitionBy("_k", "_share")
    named = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(p).alias("share")) for n, p in shares.items()))
    chosen = None
    for bits in (12, 24, 36, 48, None):
        at = v if bits is None else bin_at(bits)
        if chosen is None:
            counts = cut(rows.groupBy("_k", at.alias("_at")).agg(F.count(F.lit(1)).alias("_n")))
            total = counts.groupBy("_k").agg(F.sum("_n").alias("_total"))
            wanted = total.select("_k", F.explode(named).alias("_x"), "_total").select(F.col("_k").alias("_q"), F.col("_x.name").alias("_share"), F.greatest(F.ceil(F.col("_x.share") * F.col("_total")), F.lit(1)).alias("_rank"))
            counts = counts.join(wanted, F.col("_k").eqNullSafe(F.col("_q")))
        else:  # the rows of the chosen bins, by the bits known so far
            near = chosen.select(F.col("_k").alias("_q"), "_share", "_rank", F.col("_at").alias("_bin"))
            inside = rows.withColumn("_b", bin_at(last)).join(near, F.col("_k").eqNullSafe(F.col("_q")) & (F.col("_b") == F.col("_bin")))
            counts = inside.groupBy("_k", "_share", "_rank", at.alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(by.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
        ranked = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
        chosen = cut(ranked.select("_k", "_share", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"), "_at"))
        last = bits
    return chosen.groupBy(F.col("_k").alias(key)).agg(*(F.max(F.when(F.col("_share") == n, F.col("_at"))).alias(n) for n in shares))


def rolling(df: DataFrame, key: str, order: list[str], value: str, size: int = 12) -> DataFrame:
    """Mean and variation of the last ``size`` values; reliable from three on with a variation under 0.35."""
    last = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - size, 0)
    n, mean, sd = F.count(value).over(last), F.avg(value).over(last), F.stddev_pop(value).over(last)
    return df.withColumns({"n": n, "avg": F.round(mean, 6), "cv": F.round(ratio(sd, mean), 6)}).withColumn("reliable", (F.col("n") >= 3) & (F.col("cv") < 0.35))


def latest(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The latest ``n`` rows of each key."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scaled to 0 to 1; null is 0; 1 where all are equal."""
    return F.when(value.isNull(), 0.0).when(high == low, 1.0).otherwise((value - low) / (high - low))


def below(rows: DataFrame, key: str, value: str, limit: float, place: list[str], others: list[Column], cut) -> DataFrame:
    """key, ``others`` (aggregates of the key) and below: whether the mean of ``value`` is below the limit, of doubles added one by one in
    the order of ``place``, as an engine does that reads the table in order.

    Doubles added in another order may differ in their last bits, which decides only where the mean is within these of the limit: only the
    rows of such keys are sorted and added in order; all other keys are sums of sums. ``cut`` writes a frame and reads it back.
    """
    parts = rows.groupBy(key).agg(*others, F.avg(value).alias("_mean"), F.avg(F.abs(value)).alias("_size"), F.count(value).alias("_n"))
    parts = cut(parts)
    close = F.abs(F.col("_mean") - limit) <= (F.col("_n") + 4) * 2.0**-52 * (F.col("_size") + abs(limit))
    upto = Window.partitionBy(key).orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.where(F.col(value).isNotNull()).join(parts.where(close).select(key), key).withColumn("_sum", F.sum(value).over(upto))
    sums = sums.groupBy(key).agg((F.max_by("_sum", F.struct(*place)) / F.count(F.lit(1)) < limit).alias("_close"))
    names = [c for c in parts.columns if not c.startswith("_")]
    return parts.join(sums, key, "left").select(*names, F.coalesce("_close", F.col("_mean") < limit).alias("below"))
