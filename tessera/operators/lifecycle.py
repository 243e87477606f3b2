"""What jobs, caches and buffers do over time, on a table of their events: stalls, expiry, time to live, flushes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _now(events: DataFrame, ts: str) -> DataFrame:
    """One row: the time of the last event."""
    return F.broadcast(events.agg(F.max(ts).cast("timestamp").alias("_now")))


def stalled(events: DataFrame, key: str, ts: str, attempt: Column, minutes: int, most: int) -> DataFrame:
    """key, attempts and what to do with it: running, requeue or fail."""
    last = events.groupBy(key).agg(F.max(ts).cast("timestamp").alias("_last"), F.count_if(attempt).alias("attempts"))
    quiet = F.col("_last") < F.col("_now") - F.expr(f"INTERVAL {minutes} MINUTES")
    action = F.when(~quiet, "running").when(F.col("attempts") < most, "requeue").otherwise("fail")
    return last.crossJoin(_now(events, ts)).select(key, "attempts", action.alias("action"))


def expired(events: DataFrame, key: str, ts: str, budget: Column, floor: int, stale: int) -> DataFrame:
    """key and whether it is older than its budget (``floor`` at least) and without news for ``stale`` seconds."""
    rows = events.groupBy(key).agg(F.min(ts).cast("timestamp").alias("_born"), F.max(ts).cast("timestamp").alias("_last"), budget.alias("_budget"))
    age = lambda c: F.unix_timestamp(F.date_trunc("second", "_now")) - F.unix_timestamp(F.date_trunc("second", c))
    return rows.crossJoin(_now(events, ts)).select(key, ((age("_born") > F.greatest("_budget", F.lit(floor))) & (age("_last") > stale)).alias("expired"))


def _histories(events: DataFrame, key: list[str], ts: str, order: str, seconds: int, longer: bool) -> DataFrame:
    """The keys' rows (t in microseconds, order) in lists, cut where the next row comes ``seconds`` (or ``longer``) after the one before:
    what is anchored at a first row and lasts so long starts anew there in any case, so that a list is a busy stretch, not a history."""
    rows = events.select(*key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), order)
    by = Window.partitionBy(*key).orderBy("_t", order)
    gap = F.col("_t") - F.lag("_t").over(by)
    new = (gap > seconds * 1_000_000) if longer else (gap >= seconds * 1_000_000)
    cut = rows.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("_stretch", F.sum("_new").over(by))
    return cut.groupBy(*key, "_stretch").agg(F.array_sort(F.collect_list(F.struct(F.col("_t").alias("t"), order))).alias("_rows"))


def ttl_hits(lookups: DataFrame, key: list[str], ts: str, order: str, seconds: int) -> DataFrame:
    """key, order and hit: whether the lookup finds its key stored ``seconds`` ago at most. A miss stores it; a hit doesn't renew it."""
    start = F.struct(F.lit(None).cast("long").alias("stored"), F.array().cast("array<boolean>").alias("out"))

    def step(a, r):
        hit = F.coalesce(r["t"] - a["stored"] <= seconds * 1_000_000, F.lit(False))
        return F.struct(F.when(hit, a["stored"]).otherwise(r["t"]).alias("stored"), F.array_append(a["out"], hit).alias("out"))

    lists = _histories(lookups, key, ts, order, seconds, True)
    rows = lists.select(*key, "_rows", F.aggregate("_rows", start, step)["out"].alias("_hit"))
    return rows.select(*key, F.explode(F.arrays_zip(F.col("_rows").alias("r"), F.col("_hit").alias("hit"))).alias("z")).select(*key, f"z.r.{order}", "z.hit")


def flushes(events: DataFrame, key: str, ts: str, order: str, most: int, seconds: int) -> DataFrame:
    """key, flush and n: a buffer is flushed when it holds ``most`` rows, or a row comes ``seconds`` or more after its first."""
    times = _histories(events, [key], ts, order, seconds, False).select(key, "_stretch", F.transform("_rows", lambda x: x["t"]).alias("_t"))
    start = F.struct(F.lit(0).cast("long").alias("first"), F.array().cast("array<long>").alias("sizes"))

    def step(a, t):
        n = F.coalesce(F.try_element_at(a["sizes"], F.lit(-1)), F.lit(0).cast("long"))
        new = (n == 0) | (n >= most) | (t - a["first"] >= seconds * 1_000_000)
        grown = F.concat(F.slice(a["sizes"], F.lit(1), F.greatest(F.size(a["sizes"]) - 1, F.lit(0))), F.array(n + 1))
        return F.struct(F.when(new, t).otherwise(a["first"]).alias("first"), F.when(new, F.array_append(a["sizes"], F.lit(1).cast("long"))).otherwise(grown).alias("sizes"))

    sizes = times.select(key, "_stretch", F.posexplode(F.aggregate("_t", start, step)["sizes"]).alias("_k", "n"))
    return sizes.select(key, F.row_number().over(Window.partitionBy(key).orderBy("_stretch", "_k")).cast("long").alias("flush"), "n")


def rate_limited(events: DataFrame, key: str, ts: str, order: str, most: int, seconds: int) -> DataFrame:
    """key, order and whether the request is allowed: ``most`` in a window that begins with its first request and lasts ``seconds``."""
    lists = _histories(events, [key], ts, order, seconds, False)
    start = F.struct(F.lit(None).cast("long").alias("first"), F.lit(0).alias("n"), F.array().cast("array<boolean>").alias("out"))

    def step(a, r):
        new = a["first"].isNull() | (r["t"] - a["first"] >= seconds * 1_000_000)
        n = F.when(new, 1).otherwise(a["n"] + 1)
        return F.struct(F.when(new, r["t"]).otherwise(a["first"]).alias("first"), n.alias("n"), F.array_append(a["out"], n <= most).alias("out"))

    rows = lists.select(key, "_rows", F.aggregate("_rows", start, step)["out"].alias("_ok"))
    return rows.select(key, F.explode(F.arrays_zip(F.col("_rows").alias("r"), F.col("_ok").alias("allowed"))).alias("z")).select(key, f"z.r.{order}", "z.allowed")
