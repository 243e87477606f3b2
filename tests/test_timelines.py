"""Ranges and points of timelines against plain loops: many pieces, one key with most rows, a null key, ties."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import timelines
from tessera.sources.folders import cut


def merged(r, least):
    r = [list(x) for x in r]
    while len(r) > 1 and any(e - s < least for s, e in r):
        i = next(i for i, (s, e) in enumerate(r) if e - s < least)
        back = i == len(r) - 1 or (i > 0 and r[i - 1][1] - r[i - 1][0] <= r[i + 1][1] - r[i + 1][0])
        k = i - 1 if back else i
        r[k : k + 2] = [[r[k][0], r[k + 1][1]]]
    return [tuple(x) for x in r]


def capped(r, most, flash):
    r = [list(x) for x in r]
    size = lambda x: x[1] - x[0]
    while len(r) > most:
        pairs = [(size(a) + size(b), i) for i, (a, b) in enumerate(zip(r, r[1:])) if min(size(a), size(b)) <= flash]
        if not pairs:
            return [tuple(r[i * len(r) // most]) for i in range(most)]
        i = min(pairs)[1]
        r[i : i + 2] = [[r[i][0], r[i + 1][1]]]
    return [tuple(x) for x in r]


def pushed(r, gap, least, end):
    out, last = [], None
    for s, n in r:
        s = s if last is None else max(s, last + gap)
        e = min(end, s + n)
        if e > s + least:
            out.append((s, e))
            last = e
    return out


def spaced(r, gap, most):
    out = []
    for p, t in sorted(set(r)):
        if len(out) < most and all(abs(t - u) >= gap for _, u in out):
            out.append((p, t))
    return out


def keyed(draw, most=400):
    """Times of several keys: one with most of them, a null key, a key with one."""
    out = {1: set(), 2: set(), None: set(), 3: {5.0}}
    at = {k: 0.0 for k in out}
    for _ in range(most):
        k = draw.choice([1, 1, 1, 1, 2, None])
        at[k] += draw.choice([1, 1, 2, 3, 5, 8, 13])
        out[k].add(at[k])
    return {k: sorted(v) for k, v in out.items()}


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r[0], []).append(tuple(r)[1:])
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("seed, width", [(1, 10), (2, 100_000)])
def test_equal_to_loops(spark, seed, width):
    draw = random.Random(seed)
    times = keyed(draw)
    points = spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts], "k int, t double").withColumn("s", F.floor(F.col("t") / width))
    ranges = timelines.ranges_between(points, "k", "s", "t").persist()
    plain = {k: list(zip(ts, ts[1:])) for k, ts in times.items() if len(ts) > 1}
    assert collected(ranges.select("k", "start", "end")) == plain
    for least in (4.0, 7.0, 1e6):
        assert collected(timelines.long_enough(ranges, "k", "s", least)) == {k: merged(r, least) for k, r in plain.items()}, least
    for most, flash in ((20, 5.0), (1, 100.0), (60, 1.0)):
        assert collected(timelines.capped(ranges, "k", "s", most, flash, cut)) == {k: capped(r, most, flash) for k, r in plain.items()}, (most, flash)
    ranges.unpersist()

    length = {t: float(draw.choice([0, 1, 2, 3, 20])) for ts in times.values() for t in ts}
    with_length = points.withColumnRenamed("t", "start").join(spark.createDataFrame(list(length.items()), "start double, n double"), "start")
    for gap, end in ((2.0, 400.0), (0.0, 1e9), (30.0, 1000.0)):
        want = {k: pushed([(t, length[t]) for t in ts], gap, 0.25, end) for k, ts in times.items()}
        got = collected(timelines.pushed(with_length, "k", "s", ["start"], F.col("n"), gap, 0.25, end))
        assert got == {k: r for k, r in want.items() if r}, (gap, end)

    ranked = points.withColumn("p", (F.col("t") * 7 % 5).cast("int"))
    ranked = ranked.unionByName(ranked.where("p = 1")).unionByName(ranked.where("p = 2").withColumn("p", F.lit(0)))  # repeated rows; one time, two ranks
    lists = collected(ranked.select("k", "p", "t"))
    for gap, most in ((3.0, 5), (12.0, 5), (6.5, 1000), (1e6, 4)):
        assert collected(timelines.spaced(ranked, "k", "s", "p", "t", gap, most)) == {k: spaced(r, gap, most) for k, r in lists.items()}, (gap, most)


def test_ranges_of_no_length(spark):
    """Costs that don't rise: ranges of length 0 beside others."""
    draw = random.Random(9)
    for _ in range(2):
        sizes = [draw.choice([0.0, 0.0, 1.0, 2.0, 6.0]) for _ in range(40)]
        starts = [100.0 * i for i in range(40)]  # apart, so that starts differ
        rows = [(1, s, s + n) for s, n in zip(starts, sizes)]
        df = spark.createDataFrame(rows, "k int, start double, end double").withColumn("s", F.floor(F.col("start") / 300))
        for most in (5, 20):
            assert collected(timelines.capped(df, "k", "s", most, 1.0, cut))[1] == sorted(capped([r[1:] for r in rows], most, 1.0))


def test_empty(spark):
    none = spark.createDataFrame([], "k int, s long, start double, end double")
    assert timelines.long_enough(none, "k", "s", 4.0).collect() == [] and timelines.capped(none, "k", "s", 5, 2.0, cut).collect() == []
    assert timelines.pushed(none, "k", "s", ["start"], F.lit(3.0), 2.0, 0.25, 9.0).collect() == []


def test_a_long_key(spark):
    """A key of 100,000 ranges in seconds, and spread: its pieces lie in every partition."""
    rows = spark.range(100_001).select(F.lit(1).alias("k"), (F.col("id") * 10 + F.pmod(F.xxhash64("id"), F.lit(9))).cast("double").alias("t")).withColumn("s", F.floor(F.col("t") / 1000))
    ranges = timelines.ranges_between(rows, "k", "s", "t").persist()
    assert ranges.count() == 100_000
    began = time.time()
    out = timelines.long_enough(ranges, "k", "s", 9.0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be put together again
    try:
        shares = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shares) == 4 and max(shares) < sum(shares) / 2
    assert out.agg(F.min(F.col("end") - F.col("start"))).first()[0] >= 9.0
    assert timelines.capped(ranges, "k", "s", 30_000, 9.0, cut).count() == 30_000
    assert time.time() - began < 60
    ranges.unpersist()
