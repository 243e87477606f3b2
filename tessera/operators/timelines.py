"""Ranges and points on a key's timeline: repaired, capped, pushed apart and chosen with a distance, as rows rather than lists.

A timeline falls into pieces that don't bear on each other, which are found with windows and settled by tasks one by one. A ``stretch`` is a
column that rises with the order (a day): windows are over a key's stretches, so that a key with much of all rows is spread over them.
Keys may be null; order columns are not null, and no two rows of a key are equal in them.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import ranking, sequences


def _joined(df: DataFrame, key: str, stretch: str, of_stretch: DataFrame) -> DataFrame:
    """``df`` with the columns that ``of_stretch`` (_k, _s, ...) holds of each key's stretches."""
    return df.join(of_stretch, F.col(key).eqNullSafe(F.col("_k")) & (F.col(stretch) == F.col("_s"))).drop("_k", "_s")


def with_previous(df: DataFrame, key: str, stretch: str, order: list[str]) -> DataFrame:
    """``df`` with the row before each in a struct ``previous``, null for a key's first row."""
    row = F.struct(*df.columns)
    ends = df.groupBy(F.col(key).alias("_k"), F.col(stretch).alias("_s")).agg(F.max_by(row, F.struct(*order)).alias("_end"))
    ends = ends.select("_k", "_s", F.lag("_end").over(Window.partitionBy("_k").orderBy("_s")).alias("_end"))
    rows = _joined(df.withColumn("_old", F.lag(row).over(Window.partitionBy(key, stretch).orderBy(*order))), key, stretch, ends)
    return rows.withColumn("previous", F.coalesce("_old", "_end")).drop("_old", "_end")


def in_pieces(df: DataFrame, key: str, stretch: str, order: list[str], begins: Column) -> DataFrame:
    """``df`` with ``piece``: the order columns of the last row, up to each, for which ``begins`` holds (it must for a key's first row)."""
    rows = df.withColumn("_first", F.when(begins, F.struct(*order)))
    last = rows.groupBy(F.col(key).alias("_k"), F.col(stretch).alias("_s")).agg(F.max("_first").alias("_began"))
    earlier = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("_k", "_s", F.last("_began", True).over(earlier).alias("_began"))
    own = F.last("_first", True).over(Window.partitionBy(key, stretch).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return _joined(rows.withColumn("_own", own), key, stretch, last).withColumn("piece", F.coalesce("_own", "_began")).drop("_first", "_own", "_began")


def _by_piece(df: DataFrame, key: str, order: list[str], columns: list[str], fn: Callable, schema: str) -> DataFrame:
    """key and what ``fn`` yields (tuples) of each piece's rows (tuples of ``columns``) in order. Tasks read sorted rows as a stream."""
    sent = df.select(F.col(key), "piece", *columns).repartition(key, "piece").sortWithinPartitions(key, "piece", *order)
    kind = dict(sent.dtypes)[key]
    fields = [part.split() for part in schema.split(", ")]
    types = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type = None

        def stream():
            nonlocal key_type
            for batch in batches:
                key_type = batch.schema.field(0).type
                pieces = zip(*(c.to_pylist() for c in batch.column(1).flatten()))
                yield from zip(zip(batch.column(0).to_pylist(), pieces), zip(*(batch.column(i + 2).to_pylist() for i in range(len(columns)))))

        def packed(out):
            keys = pa.array([k for k, _ in out], key_type)
            return pa.RecordBatch.from_arrays([keys, *(pa.array(v, types[t]) for v, (_, t) in zip(zip(*(r for _, r in out)), fields))], names=[key, *(n for n, _ in fields)])

        out = []
        for (k, _), rows in groupby(stream(), key=lambda r: r[0]):
            for row in fn(row for _, row in rows):
                out.append((k, row))
                if len(out) == 10_000:
                    yield packed(out)
                    out.clear()
        if out:
            yield packed(out)

    return sent.mapInArrow(run, f"`{key}` {kind}, {schema}")


def ranges_between(points: DataFrame, key: str, stretch: str, at: str) -> DataFrame:
    """key, stretch, start and end: the ranges between the distinct points (key, stretch, at) of each key."""
    rows = with_previous(points, key, stretch, [at]).where("previous IS NOT NULL")
    return rows.select(key, stretch, F.col(f"previous.{at}").alias("start"), F.col(at).alias("end"))


def _long_enough(least: float):
    def run(rows):
        last, this = None, None  # last is long; this is the first whose fate is open
        for start, end in rows:
            if this is None:
                this = [start, end]
            elif this[1] - this[0] >= least:
                if last:
                    yield tuple(last)
                last, this = this, [start, end]
            elif last and last[1] - last[0] <= end - start:
                last[1], this = this[1], [start, end]
            else:
                this[1] = end
        if last and this[1] - this[0] < least:
            last[1], this = this[1], None
        yield from (tuple(r) for r in (last, this) if r)

    return run


def long_enough(ranges: DataFrame, key: str, stretch: str, least: float) -> DataFrame:
    """key, start, end: of adjacent ranges (key, stretch, start, end) the first of those shorter than ``least`` merged into its shorter
    neighbour (the one before, among equals), again and again until none is left or one range is.

    What stands before the first short range is long and stays, so that one pass with two ranges in hand does it. Between two ranges
    that are long from the first nothing passes: a piece begins there.
    """
    long = lambda r: F.col(r + "end") - F.col(r + "start") >= least
    rows = with_previous(ranges.select(key, stretch, "start", "end"), key, stretch, ["start"])
    rows = in_pieces(rows, key, stretch, ["start"], F.col("previous").isNull() | (long("") & long("previous.")))
    return _by_piece(rows, key, ["start"], ["start", "end"], _long_enough(least), "start double, end double")


def _merges(flash: float):
    def run(rows):
        starts, ends = map(list, zip(*rows))
        n = len(starts)
        before, after, size = [i - 1 for i in range(n)], [i + 1 for i in range(n)], [e - s for s, e in zip(starts, ends)]
        version, heap = [0] * n, []  # a range is known by its first; a merge makes what the heap holds of it void

        def offer(i):
            j = after[i]
            if i >= 0 and j < n and min(size[i], size[j]) <= flash:
                heapq.heappush(heap, (size[i] + size[j], starts[i], i, j, version[i], version[j]))

        for i in range(n - 1):
            offer(i)
        most = (float("-inf"), float("-inf"))
        step = 0
        while heap:
            cost, _, i, j, vi, vj = heapq.heappop(heap)
            if vi != version[i] or vj != version[j]:
                continue
            most, step = max(most, (cost, starts[i])), step + 1
            yield (starts[j], *most, step)
            ends[i], after[i] = ends[j], after[j]
            size[i], version[i], version[j] = ends[i] - starts[i], version[i] + 1, -1
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])

    return run


def capped(ranges: DataFrame, key: str, stretch: str, most: int, flash: float, cut: Callable) -> DataFrame:
    """key, start, end: at most ``most`` of a key's adjacent ranges (key, stretch, start, end). The two neighbours that are shortest together,
    one of them ``flash`` or less, become one (the first among equals), again and again; without such a pair every n / ``most``-th stays.

    Two neighbours longer than ``flash`` never become one, so that pieces between them can be merged to the end apart, each with a
    queue. A key's merges are those of its pieces by cost: as many as it needs are taken, the first ones. What a merge costs within
    a piece doesn't fall, but for ranges of no length; the highest cost so far stands for it, which gives the order of one queue.
    A task holds one piece. ``cut`` writes a frame and reads it back; ranges, merges and what they leave are written once each.
    """
    size = lambda r: F.col(r + "end") - F.col(r + "start")
    counts = ranges.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    rows = cut(ranges.select(key, stretch, "start", "end").join(counts, F.col(key).eqNullSafe(F.col("_k"))).drop("_k"))
    few, many = rows.where(F.col("_n") <= most).select(key, "start", "end"), rows.where(F.col("_n") > most)

    pieces = with_previous(many, key, stretch, ["start"])
    pieces = in_pieces(pieces, key, stretch, ["start"], F.col("previous").isNull() | ((size("") > flash) & (size("previous.") > flash)))
    merges = cut(_by_piece(pieces, key, ["start"], ["start", "end"], _merges(flash), "right double, cost double, left double, step long"))
    merges = merges.select(F.struct(key).alias("_id"), "*", F.floor("cost").alias("_level"))  # in a struct a null key is a key like others
    merges = sequences.numbered(merges, ["_id"], "_level", ["cost", "left", "step"], "_nth").select(F.col(key).alias("_k"), F.col("right").alias("_right"), "_nth")

    taken = many.join(merges, F.col(key).eqNullSafe(F.col("_k")) & (F.col("start") == F.col("_right")), "left")
    first = F.coalesce(F.col("_nth") > F.col("_n") - most, F.lit(True))
    merged = in_pieces(taken.select(key, stretch, "start", "end", first.alias("_begins")), key, stretch, ["start"], F.col("_begins"))
    merged = merged.groupBy(key, "piece").agg(F.min(stretch).alias("_stretch"), F.min("start").alias("start"), F.max("end").alias("end"))
    merged = cut(merged.select(F.struct(key).alias("_id"), key, "_stretch", "start", "end"))
    left = merged.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"))
    placed = sequences.numbered(merged, ["_id"], "_stretch", ["start"], "_nth").join(left, "_id")
    placed = placed.withColumn("_turn", F.expr(f"((_nth - 1) * {most} + _n - 1) div _n"))  # the only i that floor(i * n / most) can take here
    even = placed.where(f"_n <= {most} OR (_turn < {most} AND (_turn * _n) div {most} = _nth - 1)")
    return few.unionByName(even.select(key, "start", "end"))


def pushed(rows: DataFrame, key: str, stretch: str, order: list[str], length: Column, gap: float, least: float, end: float) -> DataFrame:
    """key, start, end: ranges (key, stretch, start) of a ``length`` in order (rising with start), each pushed back to ``gap`` after the one
    before; its length is kept up to ``end``, and it goes if ``least`` or less is left.

    A range starts at its own start or as late as all since some earlier one, put end to end, make it: with c the lengths and gaps
    before a range, at c + max(start - c) over it and those before. That is a running sum and a running maximum, which are carried
    over a key's stretches. A range that goes by ``end`` has only such after it. Sums of fractions may differ from adding one by one.
    """
    rows = rows.withColumn("_length", length).where(F.col("_length") > least)
    here = Window.partitionBy(key, stretch).orderBy(*order)
    rows = rows.withColumn("_c", F.coalesce(F.sum(F.col("_length") + gap).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("_late", F.max(F.col("start") - F.col("_c")).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy(F.col(key).alias("_k"), F.col(stretch).alias("_s")).agg(F.sum(F.col("_length") + gap).alias("_all"), F.max("_late").alias("_most"))
    earlier = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum("_all").over(earlier), F.lit(0.0)))
    parts = parts.select("_k", "_s", "_base", F.max(F.col("_most") - F.col("_base")).over(earlier).alias("_carried"))
    start = F.col("_base") + F.col("_c") + F.greatest(F.col("_late") - F.col("_base"), F.col("_carried"))
    out = _joined(rows, key, stretch, parts).select(key, start.alias("start"), F.least(F.lit(end), start + F.col("_length")).alias("end"))
    return out.where(F.col("end") > F.col("start") + least)


def _spaced(gap: float, most: int):
    def run(rows):
        taken: dict[int, float] = {}  # two of one slot would be too near; one can only clash with its own and the two beside it
        for rank, at in rows:
            slot = int(at // gap)
            if len(taken) < most and all(abs(taken[s] - at) >= gap for s in (slot - 1, slot, slot + 1) if s in taken):
                taken[slot] = at
                yield rank, at

    return run


def spaced(rows: DataFrame, key: str, stretch: str, rank: str, at: str, gap: float, most: int) -> DataFrame:
    """key, rank, at of rows (key, stretch, rank int, at double): by rank, then time, each that lies ``gap`` or more from all taken so far,
    ``most`` at most.

    Where ``gap`` or more lies between two rows a piece begins; the first ``most`` of each piece's choice are enough for the key's.
    A task holds what it has taken of one piece.
    """
    rows = with_previous(rows.select(key, stretch, rank, at).distinct(), key, stretch, [at, rank])
    rows = in_pieces(rows, key, stretch, [at, rank], F.col("previous").isNull() | (F.col(at) - F.col(f"previous.{at}") >= gap))
    found = _by_piece(rows, key, [rank, at], [rank, at], _spaced(gap, most), f"{rank} int, {at} double")
    return ranking.top(found, key, [F.col(rank), F.col(at)], most).select(key, rank, at)
