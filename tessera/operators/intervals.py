"""Cuts and intervals: merging near cuts, ranges between cuts, splitting, and overlap joins by time bins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import sequences


def merge_cuts(cuts: Column, gap: float) -> Column:
    """Ascending cuts, each kept if it lies ``gap`` or more after the last one kept."""
    return F.aggregate(F.array_sort(cuts), F.array().cast("array<double>"), lambda kept, t: F.when((F.size(kept) == 0) | (t - F.try_element_at(kept, F.lit(-1)) >= gap), F.array_append(kept, t)).otherwise(kept))


def ranges(cuts: Column, duration: Column, least: float) -> Column:
    """Adjacent ranges from 0 over the cuts to the duration, without those shorter than ``least``."""
    points = F.concat(F.array(F.lit(0.0)), F.filter(cuts, lambda t: (t > 0) & (t < duration)), F.array(duration))
    pairs = F.transform(F.sequence(F.lit(0), F.size(points) - 2), lambda i: F.struct(points[i].alias("start"), points[i + 1].alias("end")))
    return F.filter(pairs, lambda r: r["end"] - r["start"] >= least)


def split(df: DataFrame, start: str, end: str, longest: float) -> DataFrame:
    """Ranges longer than ``longest`` as equal parts: columns part_start and part_end beside the others."""
    n = F.greatest(F.ceil((F.col(end) - F.col(start)) / longest), F.lit(1))
    parts = df.withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), n))).withColumn("n_parts", n)
    step = (F.col(end) - F.col(start)) / F.col("n_parts")
    return parts.withColumns({"part_start": F.col(start) + step * (F.col("part") - 1), "part_end": F.col(start) + step * F.col("part")}).drop("n_parts")


def overlaps(left: DataFrame, right: DataFrame, key: str, width: float) -> DataFrame:
    """Pairs of rows (id, key, start, end) of one key whose half-open ranges overlap, by bins of ``width``; a pair is kept in the bin
    where its overlap begins, so that it comes once."""
    bins = lambda: F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))
    a = left.select(key, F.col("id").alias("left_id"), F.col("start").alias("s1"), F.col("end").alias("e1"), bins().alias("bin"))
    b = right.select(key, F.col("id").alias("right_id"), F.col("start").alias("s2"), F.col("end").alias("e2"), bins().alias("bin"))
    first = F.floor(F.greatest("s1", "s2") / width)
    pairs = a.join(b, [key, "bin"]).where((F.col("s1") < F.col("e2")) & (F.col("s2") < F.col("e1")) & (F.col("bin") == first))
    return pairs.select(key, "left_id", "right_id", (F.least("e1", "e2") - F.greatest("s1", "s2")).alias("overlap"))


def adjacent(df: DataFrame, key: str, gap: float) -> DataFrame:
    """Pairs of rows (id, key, start, end) of one key of which an end and a beginning, or both beginnings, lie ``gap`` or less apart:
    key, left_id, right_id with left_id < right_id. Points meet in bins of width ``gap`` and their neighbours."""
    points = F.array(F.struct(F.lit(0).alias("k"), F.col("start").alias("p")), F.struct(F.lit(1).alias("k"), F.col("end").alias("p")))
    rows = df.select(key, "id", F.explode(points).alias("x")).select(key, "id", "x.k", "x.p", F.floor(F.col("x.p") / gap).alias("bin"))
    a = rows.select(key, F.col("id").alias("left_id"), F.col("k").alias("ka"), F.col("p").alias("pa"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    b = rows.select(key, F.col("id").alias("right_id"), F.col("k").alias("kb"), F.col("p").alias("pb"), "bin")
    near = a.join(b, [key, "bin"]).where((F.col("left_id") < F.col("right_id")) & (F.abs(F.col("pa") - F.col("pb")) <= gap) & (F.col("ka") + F.col("kb") < 2))
    return near.select(key, "left_id", "right_id").distinct()


#: What a segment may have besides its time, in the order of its bits.
MARKS = ["close", "persons", "emotion", "micro", "hit"]


def _best_of_few(key: str, lengths: list[int]):
    """The best windows of rows (key, duration, segments): places where segments enter or leave are made and added up in arrays."""

    def of(lasts, sizes, start, end, marks, n):
        """Rows with a window of ``n``, its place and its score."""
        most = np.where(lasts >= n, np.floor((lasts - n) * 2), -1)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        enters, leaves = np.maximum(0, np.floor((start - n) * 2) + 1), np.ceil(end * 2)
        on = np.flatnonzero((enters < leaves) & (most[owner] >= 0))
        have = np.flatnonzero(most >= 0)
        row = np.r_[have, owner[on], owner[on]]
        at = np.r_[np.zeros(len(have)), enters[on], leaves[on]]
        order = np.lexsort((at, row))
        row, at = row[order], at[order]
        last = np.r_[(row[1:] != row[:-1]) | (at[1:] != at[:-1]), True][: len(row)] & (at <= most[row])
        row, at = row[last], at[last].astype(np.int64)
        sums = lambda x: np.cumsum(np.r_[np.zeros(len(have), np.int64), x, -x][order])[last]
        here = [sums(marks[on] >> k & 1) for k in range(len(MARKS))]
        score = 50 + sum((c > 0) * p for c, p in zip(here, (10, 8, 7, 8))) + np.minimum(10, 4 * here[4]) - 5 * (n > 10)
        score = np.where(sizes[row] == 0, 50, np.where(sums(np.ones(len(on), np.int64)) == 0, 30, np.clip(score, 0, 100)))
        best = np.lexsort((at, -score, row))
        first = best[np.r_[True, row[best][1:] != row[best][:-1]][: len(best)]]
        return row[first], at[first], score[first]

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            fields = lists.flatten()
            start, end, marks = (fields.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            lasts = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            for n in lengths:
                row, at, score = of(lasts, sizes, start, end, marks, n)
                columns = [batch.column(0).take(pa.array(row)), pa.array(np.full(len(row), n, np.int32)), pa.array(at / 2), pa.array(score.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "duration", "start", "score"])

    return run


def best_windows(clips: DataFrame | None, segments: DataFrame, key: str, lengths: list[int], cut=lambda df: df, many: int = 1000) -> DataFrame:
    """key, duration, start, score: of the windows of each length that begin at half seconds and end within the clip, the first of the best.

    ``clips`` are (key, duration), or None where a clip ends with its last segment; ``segments`` (key, start, end, close, persons, emotion,
    micro, hit), of which a window has those that overlap it. Lengths beyond the clip give no row. The segments of a key come together
    once, as a list; keys of more than ``many`` segments are dealt by stretches instead. ``cut`` writes a frame and reads it back.

    Fixed values: 50, 30 without a segment in the window (50 without any in the clip); 10, 8, 7 and 8 for a close shot, persons, strong
    emotion and a small event; 4 for each hit, at most 10; 5 less above 10 seconds.
    """
    crowded = cut(segments.groupBy(key).agg(F.count(F.lit(1)).alias("_all")).where(F.col("_all") > many).select(key))
    if crowded.isEmpty():
        return _few(clips, segments, key, lengths)
    part = lambda df, how: df if df is None else df.join(crowded, key, how)
    some = part(segments, "left_semi")
    long = some.groupBy(key).agg(F.max("end").alias("duration")) if clips is None else part(clips, "left_semi")
    return _few(part(clips, "left_anti"), part(segments, "left_anti"), key, lengths).unionByName(_by_stretches(long, some, key, lengths))


def _few(clips: DataFrame | None, segments: DataFrame, key: str, lengths: list[int]) -> DataFrame:
    """best_windows() of keys whose segments are few enough to be a list."""
    marks = sum((F.when(F.col(c), 1 << k).otherwise(0) for k, c in enumerate(MARKS)), F.lit(0))
    one = F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), marks.alias("marks"))
    lists = segments.groupBy(key).agg(F.collect_list(one).alias("_rows"), F.max("end").alias("_end"))
    rows = lists.withColumn("duration", F.col("_end")) if clips is None else clips.join(lists, key, "left")
    rows = rows.where("duration IS NOT NULL").select(key, F.col("duration").cast("double"), F.coalesce("_rows", F.array().cast(lists.schema["_rows"].dataType)).alias("_rows"))
    return rows.mapInArrow(_best_of_few(key, lengths), f"{key} {segments.schema[key].dataType.simpleString()}, duration int, start double, score long")


def _by_stretches(clips: DataFrame, segments: DataFrame, key: str, lengths: list[int]) -> DataFrame:
    """best_windows() of keys with many segments. A score changes only where a segment enters or leaves the window: only these places are
    made, as differences that add up in order over stretches, so that the work follows the segments and not the seconds."""
    sums = ["n", *MARKS]
    lasting = F.explode(F.array(*map(F.lit, lengths)))
    room = clips.join(segments.groupBy(key).agg(F.count(F.lit(1)).alias("_all")), key, "left").select(key, "_all", "duration", lasting.alias("_n"))
    room = room.where("duration >= _n").select(key, F.coalesce("_all", F.lit(0)).alias("_all"), "_n", F.floor((F.col("duration") - F.col("_n")) * 2).alias("_most"))

    enters = F.greatest(F.lit(0), F.floor((F.col("start") - F.col("_n")) * 2) + 1)
    places = F.explode(F.array(F.struct(enters.alias("at"), F.lit(1).alias("sign")), F.struct(F.ceil(F.col("end") * 2).alias("at"), F.lit(-1).alias("sign"))))
    flags = [F.when(F.col(c), 1).otherwise(0).alias(c) for c in sums[1:]]
    moves = segments.select(key, "start", "end", F.lit(1).alias("n"), *flags, lasting.alias("_n")).where(enters < F.ceil(F.col("end") * 2)).select("*", places.alias("_p"))
    moves = moves.select(key, "_n", F.col("_p.at").alias("_at"), *((F.col(c) * F.col("_p.sign")).alias(c) for c in sums))
    whole = moves.unionByName(room.select(key, "_n", F.lit(0).cast("long").alias("_at"), *(F.lit(0).alias(c) for c in sums)))
    whole = whole.groupBy(key, "_n", "_at").agg(*(F.sum(c).alias(c) for c in sums)).withColumn("_stretch", F.floor(F.col("_at") / 1000))
    rows = sequences.running(whole, [key, "_n"], "_stretch", "_at", sums).join(room, [key, "_n"]).where("_at <= _most")

    has = lambda c, points: F.when(F.col(c) > 0, points).otherwise(0)
    score = 50 + has("close", 10) + has("persons", 8) + has("emotion", 7) + has("micro", 8) + F.least(F.lit(10), 4 * F.col("hit")) - F.when(F.col("_n") > 10, 5).otherwise(0)
    score = F.when(F.col("_all") == 0, 50).when(F.col("n") == 0, 30).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), score)))
    best = rows.withColumn("_score", score).groupBy(key, "_n").agg(F.max(F.struct("_score", (-F.col("_at")).alias("_at"))).alias("_b"))
    return best.select(key, F.col("_n").alias("duration"), (-F.col("_b._at") / 2).alias("start"), F.col("_b._score").alias("score"))
