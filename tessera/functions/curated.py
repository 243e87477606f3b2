"""The score of a curated clip for a beat: rules in their order, since floors and bonuses in between depend on what came before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pairs(asked: Column, tags: Column, test) -> Column:
    """How many pairs of an asked tag and a clip's tag pass the test; 0 where one is missing."""
    each = lambda q: F.size(F.filter(tags, lambda t: test(q, t)))
    return F.coalesce(F.aggregate(asked, F.lit(0), lambda n, q: n + each(q)), F.lit(0))


def _near(q: Column, t: Column) -> Column:
    return F.contains(t, q) | F.contains(q, t)


def _when(test: Column, points) -> Column:
    return F.when(test, points).otherwise(0)


def person(tags: Column, text: Column) -> Column:
    """Whether a tag of four letters or more is named by the text."""
    return F.coalesce(F.exists(tags, lambda t: (F.length(t) >= 4) & F.contains(text, t)), F.lit(False))


def scored(rows: DataFrame, kinds: list[str], name: str = "score") -> DataFrame:
    """``rows`` (structs ``clip`` and ``beat`` among their columns) with the score. Points and hits so far are columns, so that each rule
    is evaluated once.

    A clip has tags (lower-case texts), moving, seconds, own_theme, wrong_place, unfit, rejected and notation (booleans: what bars it), extra
    (what looks and format add), audit, and shows (kinds); a beat has text, tags, visual, places, anchors, topics, kinds (the tags of each
    kind that it wants, by kind), scene, theme and theme_video. Missing lists and texts are empty, missing booleans false, numbers 0.

    Fixed values: 200 for a person; 42 and 16 for beat tags that equal or hold each other; 22 for visual tags; 85, 50 and -60 for two, one
    and no places, 250 less for a wrong one; 55 with 18 a hit, or -140, for a kind; 48 for all anchors; 150 from two hits on, 80 from three;
    16 and 6 for topics, 5 and 2 if the text doesn't name them; 60 less without any hit; 40 for the theme, 400 less off it; 22 and 58 for
    moving pictures with one and more hits, 12 from three seconds on.
    """
    clip, beat = (lambda n: F.col(f"clip.{n}")), (lambda n: F.col(f"beat.{n}"))
    texts = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    is_ = lambda c: F.coalesce(c, F.lit(False))
    number = lambda c: F.coalesce(c, F.lit(0))
    floor0 = lambda c: F.greatest(F.lit(0), c)
    total, hits, tags, text = F.col("_total"), F.col("_hits"), F.col("_tags"), F.col("_text")

    df = rows.withColumns({"_tags": texts(clip("tags")), "_text": F.lower(F.coalesce(beat("text"), F.lit("")))})
    asked = texts(beat("tags"))
    df = df.withColumns({
        "_named": person(tags, text), "_equal": _pairs(asked, tags, lambda q, t: q == t), "_held": _pairs(asked, tags, _near),
        "_seen": _pairs(texts(beat("visual")), tags, _near), "_sited": _pairs(texts(beat("places")), tags, _near),
    })
    df = df.withColumns({
        "_total": _when(F.col("_named"), 200) + 42 * F.col("_equal") + 16 * (F.col("_held") - F.col("_equal")) + 22 * F.col("_seen"),
        "_hits": _when(F.col("_named"), 3) + F.col("_held") + F.col("_seen"),
        "_told": (F.trim("_text") != "") & (F.size(texts(beat("places"))) > 0),
    })
    sited = F.col("_sited")
    placed = total + _when(F.col("_told"), F.when(sited >= 2, 85).when(sited >= 1, 50).when(hits < 2, -60).otherwise(0))
    df = df.withColumns({"_total": placed, "_hits": hits + _when(F.col("_told"), F.least(F.lit(2), sited))})
    df = df.withColumn("_total", F.when(F.col("_told") & is_(clip("wrong_place")), floor0(total - 250)).otherwise(total))

    for kind in kinds:
        wanted, shows = F.try_element_at(beat("kinds"), F.lit(kind)), F.array_contains(texts(clip("shows")), kind)
        points = F.when(shows, 55 + 18 * _pairs(wanted, tags, _near)).otherwise(-140)
        df = df.withColumns({"_total": total + _when(wanted.isNotNull(), points), "_hits": hits + _when(wanted.isNotNull() & shows, 2)})

    anchors, hay = texts(beat("anchors")), F.array_join("_tags", " ")
    df = df.withColumn("_anchored", (F.size(anchors) >= 2) & F.forall(anchors, lambda a: F.contains(hay, a)))
    df = df.withColumns({"_total": total + _when(F.col("_anchored"), 48) + number(beat("scene")), "_hits": hits + _when(F.col("_anchored"), 2)})
    worth = lambda a, named, else_: F.when(F.contains(text, a), named).otherwise(else_)
    topic = lambda a: F.aggregate(tags, F.lit(0), lambda n, t: n + F.when(t == a, worth(a, 16, 5)).when(_near(a, t), worth(a, 6, 2)).otherwise(0))
    df = df.withColumn("_total", total + _when(hits >= 2, 150) + _when(hits >= 3, 80) + F.aggregate(texts(beat("topics")), F.lit(0), lambda n, a: n + topic(a)))
    df = df.withColumn("_total", F.when((F.size(asked) >= 2) & (hits == 0), floor0(total - 60)).otherwise(total))

    own, theme = is_(clip("own_theme")), is_(beat("theme"))
    moving = F.when(is_(clip("moving")), F.when(hits == 1, 22).when(hits >= 2, 58 + _when(clip("seconds") >= 3, 12)).otherwise(0)).otherwise(0)
    df = df.withColumn("_total", total + _when(own & theme, 40) + number(clip("extra")) + moving)
    df = df.withColumn("_total", F.when(own & ~theme & ~is_(beat("theme_video")), floor0(total - 400)).otherwise(total))
    barred = is_(clip("unfit")) | is_(clip("rejected")) | is_(clip("notation"))
    return df.select(*(F.col(c) for c in rows.columns), F.when(barred, 0).otherwise(total + number(clip("audit"))).cast("long").alias(name))
