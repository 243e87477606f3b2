"""Sequences: clamped sums, places in runs, bands of scores and numbers in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _clamped(steps: Column, low: int, high: int) -> Column:
    """Steps x -> clamp(x + step) put one after another: they are x -> greatest(least(x + shift, most), least)."""
    clamp = lambda x: F.greatest(F.lit(low).cast("long"), F.least(F.lit(high).cast("long"), x))
    start = F.struct(F.lit(0).cast("long").alias("shift"), F.lit(low).cast("long").alias("least"), F.lit(high).cast("long").alias("most"))
    add = lambda a, s: F.struct((a["shift"] + s).alias("shift"), clamp(a["least"] + s).alias("least"), clamp(a["most"] + s).alias("most"))
    return F.aggregate(steps, start, add)


def clamped_sum(df: DataFrame, key: str, part: str, order: list[str], step: str, low: int, high: int) -> DataFrame:
    """key, total: from 0, each step is added and the sum held within the bounds.

    Steps compose, so that each ``part`` of a key (a time bucket that ascends with ``order``) is reduced to three numbers
    before a key's parts meet: a key with much of all rows is spread over its parts.
    """
    steps = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(step).alias("_step")))), lambda s: s["_step"])
    parts = df.groupBy(key, part).agg(_clamped(steps, low, high).alias("_f"))
    whole = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(part).alias("_part"), "_f"))).alias("_parts"))
    go = lambda x, p: F.greatest(F.least(x + p["_f"]["shift"], p["_f"]["most"]), p["_f"]["least"])
    return whole.select(key, F.aggregate("_parts", F.lit(0).cast("long"), go).alias("total"))


def in_runs(df: DataFrame, key: str, stretch: str, order: list[str], value: str) -> DataFrame:
    """``df`` with, of each row: previous, the value before it in a struct (null for a key's first row); before, how many equal values
    stand directly before it; run_length, how long its run of equal values is. Null is a value like others.

    Runs compose: rows are numbered within a ``stretch`` (a column that rises with the order), and a key's stretches, of which only the
    values at both ends and the lengths of the runs there are kept, tell what goes on from one to the next. So a key with much of all
    rows is spread over its stretches.
    """
    part, held = Window.partitionBy(key, stretch), F.struct(F.col(value).alias("value"))
    rows = df.withColumn("_old", F.lag(held).over(part.orderBy(*order)))
    rows = rows.withColumn("_new", (F.col("_old").isNull() | ~F.col("_old.value").eqNullSafe(F.col(value))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(part.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(key, stretch, "_run")
    rows = rows.withColumns({"_place": F.row_number().over(run.orderBy(*order)), "_length": F.count(F.lit(1)).over(run)})

    ends = rows.groupBy(F.col(key).alias("_k"), F.col(stretch).alias("_s")).agg(
        F.max("_run").alias("_runs"), F.min_by(held, "_run").alias("_first"), F.max_by(held, "_run").alias("_last"), F.min_by("_length", "_run").alias("_head"), F.max_by("_length", "_run").alias("_tail")
    )
    whole = F.col("_runs") == 1
    for name, by, near, far, mine, its in (("_before", [F.col("_s").asc()], "_first", "_last", "_tail", "_held"), ("_after", [F.col("_s").desc()], "_last", "_first", "_head", "_kept")):
        # a run that fills its stretch hands on what it took over; others hand on what they end with
        w = Window.partitionBy("_k").orderBy(*by)
        ends = ends.withColumn("_meets", F.coalesce(F.lag(far).over(w).isNotNull() & (F.lag(far).over(w) == F.col(near)), F.lag(far).over(w).isNotNull() & F.lag(far).over(w).eqNullSafe(F.col(near))))
        ends = ends.withColumn("_chain", F.sum((~(whole & F.col("_meets"))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        ends = ends.withColumn(its, F.sum(mine).over(Window.partitionBy("_k", "_chain").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)))
        ends = ends.withColumn(name, F.when(F.col("_meets"), F.lag(its).over(w)).otherwise(0))
    ends = ends.withColumn("_previous", F.lag("_last").over(Window.partitionBy("_k").orderBy("_s"))).select("_k", "_s", "_runs", "_before", "_after", "_previous")
    rows = rows.join(ends, F.col(key).eqNullSafe(F.col("_k")) & F.col(stretch).eqNullSafe(F.col("_s")))
    begins, goes = F.when(F.col("_run") == 1, F.col("_before")).otherwise(0), F.when(F.col("_run") == F.col("_runs"), F.col("_after")).otherwise(0)
    return rows.select(*[F.col(c) for c in df.columns], F.coalesce("_old", "_previous").alias("previous"), (F.col("_place") - 1 + begins).cast("long").alias("before"), (F.col("_length") + begins + goes).cast("long").alias("run_length"))


def bands(lists: DataFrame, key: str, rows: str, width: float) -> DataFrame:
    """key, the rows' columns and band. ``rows`` ascend by ``minus``, the negated score; a band holds what lies within ``width`` of its top."""
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(0).alias("band"), F.array().cast("array<int>").alias("out"))

    def step(a, r):
        new = a["top"].isNull() | (a["top"] + r["minus"] > width)
        band = a["band"] + new.cast("int")
        return F.struct(F.when(new, -r["minus"]).otherwise(a["top"]).alias("top"), band.alias("band"), F.array_append(a["out"], band).alias("out"))

    found = lists.select(key, rows, F.aggregate(rows, start, step)["out"].alias("_bands"))
    zipped = F.explode(F.arrays_zip(F.col(rows).alias("r"), F.col("_bands").alias("band")))
    return found.select(key, zipped.alias("z")).select(key, "z.r.*", "z.band")


def broken_runs(lists: DataFrame, key: str, rows: str, longest: int, others: list[str]) -> DataFrame:
    """key, event_id and value: the values of ``rows`` (event_id, event_type) in order, of which no more than ``longest`` in a row are
    equal; the next one is taken from ``others`` in turn (the one after it, if that is the same value)."""
    alt = F.array(*map(F.lit, others))
    start = F.struct(F.lit(None).cast("string").alias("value"), F.lit(0).alias("run"), F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"))

    def step(a, r):
        same = F.coalesce(a["value"] == r["event_type"], F.lit(False))
        full = same & (a["run"] >= longest)
        turn = lambda k: F.element_at(alt, k % len(others) + 1)
        value = F.when(full, F.when(turn(a["used"]) == r["event_type"], turn(a["used"] + 1)).otherwise(turn(a["used"]))).otherwise(r["event_type"])
        run = F.when(same & ~full, a["run"] + 1).otherwise(1)
        return F.struct(value.alias("value"), run.alias("run"), (a["used"] + full.cast("int")).alias("used"), F.array_append(a["out"], value).alias("out"))

    found = lists.select(key, rows, F.aggregate(rows, start, step)["out"].alias("_values"))
    return found.select(key, F.explode(F.arrays_zip(F.col(rows).alias("r"), F.col("_values").alias("value"))).alias("z")).select(key, "z.r.event_id", "z.value")


def numbered(df: DataFrame, key: list[str], stretch: str, order: list[str], name: str) -> DataFrame:
    """``df`` with each row's number from 1 in order within its key. ``stretch`` is a column that rises with the order: rows are numbered
    within a stretch, after the counts of the stretches before it, so that a key with much of all rows is not sorted in one task."""
    counts = df.groupBy(*key, stretch).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*(key or [F.lit(1)])).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*key, stretch, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*key, stretch).orderBy(*order))
    return df.withColumn("_place", place).join(counts, [*key, stretch]).withColumn(name, F.col("_before") + F.col("_place")).drop("_before", "_place")


def running(df: DataFrame, key: list[str], stretch: str, order: str, columns: list[str]) -> DataFrame:
    """``df`` with each of the columns as its sum up to and with the row. Sums are taken within a ``stretch`` (a column that rises with
    the order), after the totals of the stretches before it; no two rows of a key are equal in ``order``, keys are not null."""
    totals = df.groupBy(*key, stretch).agg(*(F.sum(c).alias(f"_before_{c}") for c in columns))
    earlier = Window.partitionBy(*key).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*key, stretch, *(F.coalesce(F.sum(f"_before_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in columns))
    upto = Window.partitionBy(*key, stretch).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({c: F.sum(c).over(upto) for c in columns}).join(totals, [*key, stretch])
    return rows.select(*((F.col(c) + F.col(f"_before_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns))
