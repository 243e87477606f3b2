"""Scores as column expressions: bounds, scaling, picture formats, tiers and hits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def lerp(a: Column, b: Column, share: Column) -> Column:
    return a + (b - a) * share


def scaled(x: Column, low: Column, high: Column) -> Column:
    """To 0 to 1 between the extremes; null is 0, and 1 where the extremes are equal."""
    return F.when(x.isNull(), 0.0).when(high == low, 1.0).otherwise((x - low) / (high - low))


def resolution(w: Column, h: Column) -> Column:
    """The shorter side over 1080, at most 1; null where a side is missing."""
    return F.when(w.isNotNull() & h.isNotNull(), F.least(F.lit(1.0), F.least(w, h) / 1080))


def orientation(w: Column, h: Column) -> Column:
    return F.when(w / h > 1.15, "landscape").when(w / h < 0.87, "portrait").when(w.isNotNull() & h.isNotNull(), "square")


def orientation_match(w: Column, h: Column, target: str) -> Column:
    """1 for the target's orientation, a half where either is square, else 0; null where a side is missing."""
    actual = orientation(w, h)
    return F.when(actual == target, 1.0).when((actual == "square") | F.lit(target == "square"), 0.5).when(actual.isNotNull(), 0.0)


def hits(hay: Column, words: list[str]) -> Column:
    """How many of the words the text holds."""
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(hay, w)))


def tiered(hay: Column, tiers: list[list[str]]) -> Column:
    """tier (5 without a hit) and base score of the first tier with a hit. 92, 78, 65, 52, 38, else 18."""
    out = F.lit(None)
    for k, (words, base) in enumerate(zip(tiers, (92, 78, 65, 52, 38)), 1):
        n = hits(hay, words)
        one = F.when(n > 0, F.struct(F.lit(k).alias("tier"), (base + F.least(F.lit(8), 3 * n)).alias("base")))
        out = one if k == 1 else F.coalesce(out, one)
    return F.coalesce(out, F.struct(F.lit(5).alias("tier"), F.lit(18).alias("base")))


def relevance(tier: Column, base: Column, entities: Column, video: Column) -> Column:
    """The base with what entities and moving pictures add; without an entity a low tier is capped."""
    score = base + F.when(entities >= 2, 10).otherwise(0) + F.when(entities >= 3, 6).otherwise(0)
    score = F.when((entities == 0) & (tier >= 4), F.least(score, F.lit(22))).otherwise(score)
    return F.greatest(F.lit(0), F.least(F.lit(100), score + F.when(video & (score >= 50), 4).otherwise(0)))


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """What the ranges a to b and c to d share."""
    return F.greatest(F.lit(0.0), F.least(b, d) - F.greatest(a, c))


def cosine(x: Column, y: Column) -> Column:
    """0 where lengths differ, one is missing or has no length."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(x) == F.size(y)) & (norm > 0), dot(x, y) / norm).otherwise(0.0)


def dhash(values: Column, side: int = 8) -> Column:
    """Of ``side`` x ``side`` values, bit by bit whether each is less than its right neighbour."""
    places = F.array(*(F.lit(r * side + c) for r in range(side) for c in range(side - 1)))
    return F.aggregate(places, F.lit(0).cast("long"), lambda h, i: h * 2 + (values[i] < values[i + 1]).cast("long"))


def _near(q: Column):
    """Whether a text holds ``q`` or is held by it."""
    return lambda x: F.contains(x, q) | F.contains(q, x)


def routing(asked: list[str], anchors: list[str], tags: Column, name: Column, words: Column) -> Column:
    """Points of an archive for what is asked. 28 for a tag, 22 for the name, 16 for each of its words, 18 for an anchor in it."""
    total = F.lit(0)
    for q in map(F.lit, asked):
        near = _near(q)
        total = total + F.when(F.exists(tags, near), 28).otherwise(0) + F.when(F.contains(name, q), 22).otherwise(0) + 16 * F.size(F.filter(words, near))
    for q in anchors:
        total = total + F.when(F.contains(name, F.lit(q)), 18).otherwise(0)
    return total.cast("long")
