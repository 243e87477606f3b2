"""Near pairs of bit hashes by the parts on which they agree.

The bits are dealt in turn to ``most`` + k parts, so that two hashes within ``most`` bits agree on k whole parts at least. Each hash is
written once for every choice of k parts, and hashes that agree on one meet; a pair is kept at the first k parts on which it agrees. k
follows the number of hashes: a larger one means more copies and fewer comparisons. Hashes that meet are compared in tiles inside the
tasks, which emit near pairs only, so that candidates are not rows of a join, and copies are never broadcast.

Choices at which more than ``crowd`` hashes meet (black pictures, say) are dealt again by what is left of the bits, and so on, so
that a crowd isn't compared pair by pair for a few common parts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many comparisons a copy costs, rows of a task, comparisons in a tile, and hashes of a choice for which no tile is worth while.
COPY, ROWS, TILE, FEW = 150, 1 << 18, 1 << 18, 32


def _agreeing(n: int, most: int, width: int, parts: int) -> int:
    """How many parts are to agree, ``parts`` at most: the number that costs least for ``n`` hashes."""
    able = [k for k in range(1, parts + 1) if most + k <= width and comb(most + k, k) <= 512] or [1]
    return min(able, key=lambda k: comb(most + k, k) * (COPY + n / 2 ** (width * k / (most + k) + 1)))


@lru_cache(1 << 14)
def _choices(bits: tuple[int, ...], most: int, ks: tuple[int, ...], path: int) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
    """Of each choice on the last level, after those in ``path``: the bits that it holds, the parts that it passes over, the bits left."""
    held, over, left = 0, (), bits
    if len(ks) > 1:
        path, last = divmod(path, comb(most + ks[-2], ks[-2]))
        held, over, left = _choices(bits, most, ks[:-1], path)[last]
    dealt = [sum(1 << b for b in left[q :: most + ks[-1]]) for q in range(most + ks[-1])]
    out = []
    for chosen in combinations(range(len(dealt)), ks[-1]):
        mask = sum(dealt[q] for q in chosen)
        passed = tuple(dealt[q] for q in range(chosen[-1]) if q not in chosen)
        out.append((held | mask, over + passed, tuple(b for b in left if not mask >> b & 1)))
    return out


def _written(bits: tuple[int, ...], most: int, ks: tuple[int, ...]):
    """Rows (path, h) at each choice: path with the choice, the bits of h that it holds, h."""
    number = comb(most + ks[-1], ks[-1])

    def run(batches):
        for batch in batches:
            paths, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for path in np.unique(paths).tolist():
                mine = hashes[paths == path]
                masks = np.array([c[0] for c in _choices(bits, most, ks, path)], np.uint64)
                for at in range(0, len(mine), max(1, 4096 // number)):
                    h = mine[at : at + max(1, 4096 // number)]
                    columns = np.repeat(path * number + np.arange(number), len(h)), (h & masks[:, None]).ravel().view(np.int64), np.tile(h, number).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["path", "held", "h"])

    return run


def _met(paths: np.ndarray, held: np.ndarray, h: np.ndarray, most: int):
    """Places i, j of near hashes that meet, in pieces; rows are sorted by (path, held)."""
    starts = np.flatnonzero(np.r_[True, (paths[1:] != paths[:-1]) | (held[1:] != held[:-1])]) if len(h) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(h)])
    ends = np.repeat(starts + sizes, sizes)
    i, step = np.flatnonzero(np.repeat(sizes <= FEW, sizes)), 1
    while len(i := i[i + step < ends[i]]):
        near = i[np.bitwise_count(h[i] ^ h[i + step]) <= most]
        yield near, near + step
        step += 1
    for start, size in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
        mine, row = h[start : start + size], 0
        while row < size:
            rows = max(1, TILE // (size - row))
            i, j = np.nonzero(np.bitwise_count(mine[row : row + rows, None] ^ mine[None, row:]) <= most)
            yield start + row + i[i < j], start + row + j[i < j]
            row += rows


def _compared(bits: tuple[int, ...], most: int, ks: tuple[int, ...]):
    """Of rows (path, held, h) the near pairs that meet there first."""
    number = comb(most + ks[-1], ks[-1])

    def first(paths, left, right):
        keep, apart = np.ones(len(paths), bool), left ^ right
        for path in np.unique(paths).tolist():
            mine = np.flatnonzero(paths == path)
            for part in _choices(bits, most, ks, path // number)[path % number][1]:
                keep[mine] &= (apart[mine] & np.uint64(part)) != 0
        left, right = left[keep].view(np.int64), right[keep].view(np.int64)
        columns = np.minimum(left, right), np.maximum(left, right), np.bitwise_count(left.view(np.uint64) ^ right.view(np.uint64)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["left_hash", "right_hash", "distance"])

    def run(batches):
        columns = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if not columns:
            return
        paths, held, h = (np.concatenate(c) for c in zip(*columns))
        order = np.lexsort((held, paths))
        paths, held, h = paths[order], held[order], h[order].view(np.uint64)
        found, waiting = [], 0
        for i, j in _met(paths, held, h, most):
            found.append((paths[i], h[i], h[j]))
            waiting += len(i)
            if waiting >= TILE:
                yield first(*map(np.concatenate, zip(*found)))
                found, waiting = [], 0
        if found:
            yield first(*map(np.concatenate, zip(*found)))

    return run


def pairs(df: DataFrame, name: str, most: int, bits: int, cut: Callable[[DataFrame], DataFrame], parts: int = 3, crowd: int = 4096) -> DataFrame:
    """left_hash, right_hash, distance of different hashes (null: none) at most ``most`` of ``bits`` bits apart, each pair once.

    ``cut`` writes a frame and reads it back. ``parts`` is the greatest number of parts that are to agree. Bits that are the same in all
    hashes are left out.
    """
    rows = cut(df.select(F.lit(0).cast("long").alias("path"), F.col(name).cast("long").alias("h")).where("h IS NOT NULL").distinct())
    said = rows.agg(F.count(F.lit(1)).alias("n"), F.bit_or("h").alias("any"), F.bit_and("h").alias("all")).first()
    varied = (said["any"] or 0) & ~(said["all"] or 0)
    places, ks, found = tuple(b for b in range(bits) if varied >> b & 1), (), []
    number, meeting, width = said["n"], said["n"], len(places)
    while True:
        ks += (_agreeing(meeting, most, width, parts),)
        written = rows.mapInArrow(_written(places, most, ks), "path long, held long, h long")
        crowds, met = None, written
        if width >= 2 * (most + 1):
            crowds = cut(written.groupBy("path", "held").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd))
            meeting = crowds.agg(F.max("n")).first()[0]
        if crowds is not None and meeting:
            met = written.join(crowds, ["path", "held"], "left_anti")
        tasks = -(-number * comb(most + ks[-1], ks[-1]) // ROWS) or 1
        found.append(met.repartition(tasks, "path", "held").mapInArrow(_compared(places, most, ks), "left_hash long, right_hash long, distance int"))
        if crowds is None or not meeting:
            break
        rows = cut(written.join(crowds, ["path", "held"], "left_semi").select("path", "h"))
        number, width = rows.count(), width - ks[-1] * (width // (most + ks[-1]))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
