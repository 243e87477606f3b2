"""Orders that a seed fixes: permutations of places by Feistel rounds, and rotations of ranked lists by the hash of a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import sequences

PRIME = 2**31 - 1
ROUNDS = 4


def round_keys(seed: int) -> list[int]:
    return [(seed * (k + 1) * 7919 + 104729 * (k + 1)) % PRIME for k in range(ROUNDS)]


def _mixed(x: Column, key: Column) -> Column:
    v = (x + key) % PRIME * 48271 % PRIME
    return v.bitwiseXOR(F.shiftright(v, 15)) * 69621 % PRIME


def permuted(place: Column, n: Column, seed: int) -> Column:
    """The new place (from 0) of a place from 0 to n - 1: each comes up once. No row needs another one for it.

    Places are taken as pairs of digits of base ceil(sqrt(n)), on which the rounds are a bijection; a result of n or more goes through them
    again until it is a place. At most base² - n, which is under 2 sqrt(n) + 1, results are none, so that it ends by then; the
    share that isn't through after eight times falls as (2 / sqrt(n))^8, and only these rows walk on.
    """
    base = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    keys = F.array(*(F.lit(k).cast("long") for k in round_keys(seed)))
    turned = lambda a, k: F.struct(a["low"].alias("high"), ((a["high"] + _mixed(a["low"], k)) % base).alias("low"))
    once = lambda x: F.aggregate(keys, F.struct(F.floor(x / base).alias("high"), (x % base).alias("low")), turned, lambda a: a["high"] * base + a["low"])
    held = lambda x: F.transform(F.array(x), lambda y: F.struct(y.alias("x"), (y < n).alias("done")))[0]
    step = lambda w, _: F.when(w["done"], w).otherwise(held(once(w["x"])))
    first = F.aggregate(F.array(*map(F.lit, range(8))), F.struct(place.cast("long").alias("x"), F.lit(False).alias("done")), step)
    rest = lambda w: F.aggregate(F.sequence(F.lit(0).cast("long"), base * base - n), w, step)["x"]
    return F.transform(F.array(first), lambda w: F.when(w["done"], w["x"]).otherwise(rest(w)))[0]


def name_seed(text: Column) -> Column:
    """FNV-1a of 32 bits over a text's UTF-16 units, as a long without sign; null for null. 2166136261 and 16777619."""
    digits = F.hex(F.encode(text, "UTF-16BE"))
    starts = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(4))).otherwise(F.array().cast("array<int>"))
    units = F.transform(starts, lambda i: F.conv(F.substring(digits, i, F.lit(4)), 16, 10).cast("long"))
    return F.when(text.isNotNull(), F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, u: h.bitwiseXOR(u) * 16777619 % 4294967296))


def _ranked(df: DataFrame, key: list[str], stretch: str, order: list[str]) -> DataFrame:
    """``df`` with _rank from 0 within its key and the key's count _n. Keys and stretches are not null."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    rows = sequences.numbered(df, key, stretch, order, "_rank").withColumn("_rank", F.col("_rank") - 1)
    return rows.join(counts, key) if key else rows.crossJoin(F.broadcast(counts))  # one row


def shuffled(df: DataFrame, key: list[str], stretch: str, order: list[str], seed: int, name: str = "place") -> DataFrame:
    """``df`` with its place from 1 in the order that the seed makes of each key's rows. ``stretch`` rises with the order: rows are numbered
    within stretches, and then each finds its place alone."""
    return _ranked(df, key, stretch, order).withColumn(name, permuted(F.col("_rank"), F.col("_n"), seed) + 1).drop("_rank", "_n")


def rotated(df: DataFrame, key: list[str], stretch: str, order: list[str], seed: Column, turn: Column, name: str = "place") -> DataFrame:
    """``df`` with its place from 1 in its key's ranked list as it begins at (seed + turn * 7919 + seed / 2^13) mod n and goes round."""
    start = (seed + turn * 7919 + F.shiftright(seed, 13)) % F.col("_n")
    return _ranked(df, key, stretch, order).withColumn(name, (F.col("_rank") - start + F.col("_n")) % F.col("_n") + 1).drop("_rank", "_n")
