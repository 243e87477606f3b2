"""Seeded orders against plain loops."""

import math

from pyspark.sql import functions as F

from tessera.operators import shuffles


def walked(x, n, seed):
    base, p = math.ceil(math.sqrt(n)), shuffles.PRIME
    while True:
        high, low = divmod(x, base)
        for k in shuffles.round_keys(seed):
            v = (low + k) % p * 48271 % p
            high, low = low, (high + (v ^ (v >> 15)) * 69621 % p) % base
        x = high * base + low
        if x < n:
            return x


def test_every_place_once(spark):
    """Small counts, where most results are no place and some rows walk more than eight times, and a large one."""
    sizes = spark.createDataFrame([(n,) for n in [*range(1, 60), 1000, 4097]], "n long")
    rows = sizes.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("x"))
    for seed in (0, 1, 2024):
        got = {}
        for n, x, y in rows.select("n", "x", shuffles.permuted(F.col("x"), F.col("n"), seed)).collect():
            got.setdefault(n, {})[x] = y
        for n, places in got.items():
            assert sorted(places.values()) == list(range(n)), n
            assert places == {x: walked(x, n, seed) for x in range(n)}, n
    far = 10**12 + 39  # a row of a table far too large for a test
    ends = spark.createDataFrame([(0,), (1,), (far - 1,)], "x long").select("x", shuffles.permuted(F.col("x"), F.lit(far), 7)).collect()
    assert {x: y for x, y in ends} == {x: walked(x, far, 7) for x in (0, 1, far - 1)}


def test_seeds_give_other_orders(spark):
    rows = spark.range(1000)
    orders = [[r[0] for r in rows.select(shuffles.permuted(F.col("id"), F.lit(1000), s)).collect()] for s in (1, 2, 3)]
    assert len(set(map(tuple, orders))) == 3
    for order in orders:
        assert sum(i == x for i, x in enumerate(order)) < 10 and abs(sum(a < b for a, b in zip(order, order[1:])) - 500) < 60


def test_name_seed(spark):
    def fnv(text):
        h, data = 2166136261, text.encode("utf-16-be")
        for i in range(0, len(data), 2):
            h = (h ^ int.from_bytes(data[i : i + 2])) * 16777619 % 2**32
        return h

    assert fnv("a") == 0xE40C292C and fnv("foobar") == 0xBF9CF968
    names = ["", "a", "foobar", "é王", "😀 two units", "x" * 5000]
    got = spark.createDataFrame([(n,) for n in [*names, None]], "t string").select("t", shuffles.name_seed(F.col("t"))).collect()
    assert {t: h for t, h in got} == {**{n: fnv(n) for n in names}, None: None}


def test_rotation(spark):
    """Lists of one and of many, over any number of stretches; a seed above 2^31."""
    lists = {"a": 1, "b": 2, "c": 57}
    df = spark.createDataFrame([(k, i, i // 5) for k, n in lists.items() for i in range(n)], "k string, i int, s int")
    for seed, turn in ((0, 0), (4000000000, 3), (8191, 1)):
        got = {}
        for r in shuffles.rotated(df, ["k"], "s", ["i"], F.lit(seed).cast("long"), F.lit(turn)).collect():
            got.setdefault(r["k"], {})[r["place"]] = r["i"]
        for k, n in lists.items():
            start = (seed + turn * 7919 + (seed >> 13)) % n
            assert [got[k][p] for p in range(1, n + 1)] == [*range(start, n), *range(start)]


def test_empty(spark):
    none = spark.createDataFrame([], "k string, i int, s int")
    assert shuffles.shuffled(none, [], "s", ["i"], 1).collect() == [] and shuffles.rotated(none, ["k"], "s", ["i"], F.lit(1), F.lit(1)).collect() == []
