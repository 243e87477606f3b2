"""Choices one after the other over the rows of a key: interleaving, placement, cursors, alignment and beats."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interleaved(counts: Column, kinds: list[str]) -> Column:
    """The kinds, each as often as counted, as one text: always the one with most left that isn't the last one (if there is one)."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(counts.alias("left"), F.lit(0).alias("last"), F.lit("").alias("plan"))
    places = F.array(*map(F.lit, range(1, len(kinds) + 1)))

    def step(a, _):
        most = lambda test: F.array_min(F.transform(F.filter(places, lambda i: (F.element_at(a["left"], i) > 0) & test(i)), lambda i: F.struct((-F.element_at(a["left"], i)).alias("n"), i.alias("i"))))["i"]
        k = F.coalesce(most(lambda i: i != a["last"]), most(lambda i: F.lit(True)))
        left = F.transform(a["left"], lambda x, i: x - (i + 1 == k).cast("long"))
        return F.struct(left.alias("left"), k.alias("last"), F.concat(a["plan"], F.element_at(F.array(*map(F.lit, kinds)), k)).alias("plan"))

    steps = F.when(total > 0, F.sequence(F.lit(1).cast("long"), total)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(steps, start, step)["plan"]


def _placed(kinds: list[int], ids: list[int], opening: bool) -> list[int]:
    """The ids in the order that the greedy choice gives. A score depends on the kind alone, so that each place looks at the first clip
    of each kind, not at all that are left.

    Fixed values: 10 for the target, -5 and -15 for repeats, -8 for archive after archive, and what suits a first place.
    """
    queues = {k: deque(i for j, i in zip(kinds, ids) if j == k) for k in set(kinds)}
    first = (4, 4, 9, -4) if opening else (8, 8, -10, 0)
    out, one, two = [], None, None
    for place in range(len(ids)):

        def rank(kind):
            target = 10 if kind == place % 4 and not (place == 0 and opening) else 0
            repeat = (5 + 15 * (kind == two) + 8 * (kind == 3)) if kind == one else 0
            return -(target - repeat + (first[kind] if place == 0 else 0)), queues[kind][0]

        kind = min((k for k, q in queues.items() if q), key=rank)
        out.append(queues[kind].popleft())
        one, two = kind, one
    return out


def placed(rows: DataFrame, key: str, kind: str, opening: str) -> DataFrame:
    """key, place, event_id of clips (key, event_id, kind, opening): one after the other the best by target, by the two before and by the
    opening, the first id among equals. Kinds 0 to 3 are the targets in turn; 3 is archive footage. A key is one sequence in one task."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("event_id", kind="stable")
        ids = _placed(part[kind].tolist(), part["event_id"].tolist(), bool(part[opening].iloc[0]))
        return pd.DataFrame({key: part[key].iloc[0], "place": range(len(ids)), "event_id": ids})

    return rows.groupBy(key).applyInPandas(run, f"{key} {dict(rows.dtypes)[key]}, place int, event_id long")


def cursor(words: Column, wanted: Column) -> Column:
    """got, the places (from 0) of the words that match the wanted ones in order, and ti, the place where the search ended."""
    start = F.struct(F.lit(0).cast("long").alias("ti"), F.lit(0).alias("si"), F.array().cast("array<long>").alias("got"))

    def step(a, w):
        want = F.try_element_at(wanted, a["si"] + 1)
        hit = F.startswith(w, want) | F.startswith(want, w)
        on = F.struct((a["ti"] + 1).alias("ti"), (a["si"] + hit.cast("int")).alias("si"), F.when(hit, F.array_append(a["got"], a["ti"])).otherwise(a["got"]).alias("got"))
        return F.when(want.isNull(), a).otherwise(on)

    return F.aggregate(words, start, step)


def aligned(rows: DataFrame, key: str, beats: str, segments: str) -> DataFrame:
    """key, beat (from 1), first, last: for each beat (a set of words) the shortest span of segments (lists of words) from the cursor on that
    holds most of its words."""
    n = F.size(segments)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:bigint,last:bigint>>").alias("out"))

    def step(a, beat):
        span = lambda j: F.flatten(F.slice(segments, a["at"] + 1, j - a["at"] + 1))
        scored = F.transform(F.sequence(a["at"], n - 1), lambda j: F.struct((-F.size(F.array_intersect(beat, span(j)))).alias("s"), j.alias("j")))
        best = F.when(a["at"] >= n, n - 1).otherwise(F.array_min(scored)["j"])
        found = F.struct(a["at"].cast("long").alias("first"), best.cast("long").alias("last"))
        return F.struct(F.least(n, best + 1).alias("at"), F.array_append(a["out"], found).alias("out"))

    out = F.aggregate(beats, start, step)["out"]
    return rows.select(key, F.posexplode(out).alias("b", "x")).select(key, (F.col("b") + 1).cast("long").alias("beat"), "x.first", "x.last")


def beats(words: Column, each: int, least: int, most: int) -> Column:
    """Of words that last ``each``, the beats (beat, first, last, from 1): ended by a sentence from ``least`` on, and at ``most``."""
    start = F.array().cast("array<struct<beat:bigint,first:bigint,last:bigint,ended:boolean>>")

    def step(got, w):
        last = F.try_element_at(got, F.lit(-1))
        new = last.isNull() | last["ended"]
        i = F.coalesce(last["last"], F.lit(0).cast("long")) + 1
        first = F.when(new, i).otherwise(last["first"])
        long = (i - first + 1) * each
        beat = F.struct((F.coalesce(last["beat"], F.lit(0).cast("long")) + new.cast("long")).alias("beat"), first.alias("first"), i.alias("last"), ((w.rlike("[.!?]$") & (long >= least)) | (long >= most)).alias("ended"))
        return F.array_append(F.when(new, got).otherwise(F.slice(got, F.lit(1), F.size(got) - 1)), beat)

    return F.aggregate(words, start, step)


def _spoken(starts: list[int], ends: list[int], stops: list[bool], least: int, most: int) -> list[list[int]]:
    """[first, last] (from 0) of the beats: ended by a sentence that lasts six tenths of ``least``, and by ``most`` in any case."""
    out, first = [], 0
    for i, end in enumerate(ends):
        lasts = end - starts[first]
        if lasts >= most or (stops[i] and 10 * lasts >= 6 * least):
            out.append([first, i])
            first = i + 1
    return out + [[first, len(ends) - 1]] * (first < len(ends))


def _merged(spans: list[list[int]], starts: list[int], ends: list[int], cap: int) -> list[list[int]]:
    """At most ``cap`` beats: the shortest one (the first of these, the last beat left out) takes up the one after it, until that holds.

    Beats are a linked list under a heap, so that a merge costs a logarithm and not a walk over all that are left."""
    lasts = lambda i: ends[spans[i][1]] - starts[spans[i][0]]
    n, after = len(spans), list(range(1, len(spans) + 1))
    heap = [(lasts(i), i) for i in range(n - 1)]
    heapq.heapify(heap)
    gone, left = set(), n
    while left > cap and left > 1:
        length, i = heapq.heappop(heap)
        if i in gone or after[i] == n or length != lasts(i):
            continue
        j = after[i]
        spans[i], after[i] = [spans[i][0], spans[j][1]], after[j]
        gone.add(j)
        left -= 1
        heapq.heappush(heap, (lasts(i), i))
    return [s for i, s in enumerate(spans) if i not in gone]


def spoken_beats(rows: DataFrame, key: str, words: str, least: int, most: int, cap: int) -> DataFrame:
    """key, beat, first, last (words from 1) and hold of the beats of spoken words (structs of word, start and end in whole units of time):
    cut at sentences and at ``most``, merged down to ``cap``, and held from ``least`` to ``most``. A text without words has no beats.

    Tasks get two numbers and a mark for each word, not the words, and settle one text after the other."""
    parts = {"_starts": lambda w: w["start"].cast("long"), "_ends": lambda w: w["end"].cast("long"), "_stops": lambda w: F.coalesce(w["word"].rlike(r"[.!?…]\s*$"), F.lit(False))}
    kinds = {"_starts": "array<bigint>", "_ends": "array<bigint>", "_stops": "array<boolean>"}
    sent = rows.select(key, *(F.coalesce(F.transform(words, fn), F.array().cast(kinds[n])).alias(n) for n, fn in parts.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch, whose, out = whole.slice(at, 500), [], []
                for i in range(batch.num_rows):
                    starts, ends, stops = (batch.column(c)[i].values.to_pylist() for c in (1, 2, 3))
                    for k, (a, b) in enumerate(_merged(_spoken(starts, ends, stops, least, most), starts, ends, cap), 1):
                        whose.append(i)
                        out.append((k, a + 1, b + 1, max(least, min(most, ends[b] - starts[a]))))
                keys = batch.column(0).take(pa.array(whose, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[c] for r in out], pa.int64()) for c in range(4))], names=[key, "beat", "first", "last", "hold"])

    return sent.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, beat long, first long, last long, hold long")
