"""Runs and percentiles where one key has most of the rows."""

import math
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tessera.operators import sequences, stats
from tessera.sources.folders import cut


@pytest.mark.parametrize("kinds, width", [(2, 3), (1, 4), (3, 1), (2, 50)])
def test_runs_compose_over_stretches(spark, kinds, width):
    """Runs that begin, end and go on over any number of stretches; a null value and a null key; one key with most rows."""
    draw, rows = random.Random(kinds * width), []
    for i in range(400):
        key = draw.choice([1, 1, 1, 1, 2, None])
        rows.append((key, i, draw.choice(["a", "b", None][:kinds]) if draw.random() < 0.3 or not rows else rows[-1][2]))
    df = spark.createDataFrame(rows, "k int, i int, v string").withColumn("s", F.floor(F.col("i") / width))
    got = {r["i"]: (r["before"], r["run_length"], r["previous"] and (r["previous"]["value"],)) for r in sequences.in_runs(df, "k", "s", ["i"], "v").collect()}
    for key in (1, 2, None):
        old = None
        for _, run in groupby([r for r in rows if r[0] == key], key=lambda r: r[2]):
            run = list(run)
            for n, (_, i, v) in enumerate(run):
                assert got[i] == (n, len(run), old), (key, i)
                old = (v,)
    assert len(got) == len(rows)


def test_percentiles_equal_sorting(spark):
    draw = random.Random(2)
    groups = {
        "normal": [draw.gauss(0, 1) for _ in range(900)],
        "same": [4.25] * 1500,
        "close": [1.0 + k * 2.0**-52 for k in range(300)],
        "powers": [s * 2.0**k for k in range(-60, 60) for s in (1, -1)],
        "odd": [0.0, -0.0, float("inf"), float("-inf"), float("nan"), 5e-324, -5e-324, 1.7e308],
        "whole": [float(draw.randrange(50)) for _ in range(400)],
        "one": [-3.5],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("normal", None), ("none", None)]
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "least": 0.0}
    got = {r["g"]: r.asDict() for r in stats.selected(spark.createDataFrame(rows, "g string, v double"), "g", "v", shares, cut).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        order = sorted(vs, key=lambda v: (math.isnan(v), v))
        for name, p in shares.items():
            want = order[max(math.ceil(p * len(order)), 1) - 1]
            assert got[g][name] == want or (math.isnan(want) and math.isnan(got[g][name])), (g, name)
