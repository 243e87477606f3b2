"""Vectors against vectors by cosine, exactly: how many are near, the smallest near id, the nearest few.

All are compared with all, in blocks inside tasks: both sides are dealt to groups of bounded size, and a task gets one group of each, so
that each row is copied once a group of the other side and candidates are not rows of a join. Products of single precision tell what is
near; where they come within their error of a limit, the cosine is computed as the SQL does (double precision, place after place), so
that results are the same to the last bit. Tasks emit sums or a few rows for each vector asked for, and no pairs.

``candidates`` is an index for vectors that cluster. The angle between unit vectors is a metric. Pivots are chosen from a bounded sample; a vector lies in the cell of its nearest pivot, in
a ring by its angle to it. By the triangle inequality a vector within ``alpha`` of x lies in a cell whose pivot is at most 2 ``alpha``
farther from x than x's own, in a ring that differs by one at most, so that x is compared with these rings only and nothing is lost. The
sample decides how much is compared, not what is found.

Equal vectors are one class: classes are compared, and members are joined to their class's result, so that copies don't multiply.
Vectors without a direction (null, empty, zero or not a number in it) are near nothing; vectors of another length than most are
compared with their own length only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import ranking

SAMPLE, PIVOTS = 1024, 64
SLACK = 1e-7
#: Bytes of a group of vectors (as doubles), rows for which a group is worth while, and rows of both sides of a product.
GROUP, WORTH, ASKED, HELD = 32 << 20, 1024, 256, 8192


def _sizes(column: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _matrix(column: pa.ListArray, rows: np.ndarray, size: int) -> np.ndarray:
    """The vectors of the rows, all of that size."""
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """In unit length and single precision; without a direction, not numbers."""
    out = np.empty(vectors.shape, np.float32)
    with np.errstate(all="ignore"):
        for at in range(0, len(vectors), HELD):
            v = vectors[at : at + HELD].astype(np.float64)
            norms = np.sqrt((v * v).sum(axis=1))[:, None]
            out[at : at + HELD] = v / np.where(np.isfinite(norms), norms, np.nan)
    return out


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        total += x.astype(np.float64) * y
    return total


def _cosines(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The cosines of rows i of a and j of b as the SQL computes them."""
    out = np.empty(len(i))
    with np.errstate(all="ignore"):
        for at in range(0, len(i), HELD):
            x, y = a[i[at : at + HELD]].astype(np.float64), b[j[at : at + HELD]].astype(np.float64)
            out[at : at + HELD] = _dots(x, y) / (np.sqrt(_dots(x, x)) * np.sqrt(_dots(y, y)))
    return out


def _rounded(x: np.ndarray) -> np.ndarray:
    """To six places, halves away from zero."""
    y = x * 1e6
    return np.where(np.abs(y) < 0.5, 0.0, np.trunc(y + np.copysign(0.5, y))) / 1e6


def _error(size: int) -> float:
    """More than products of single precision may be off."""
    return max(1e-5, 2e-7 * size)


def _products(asked, held, size: int):
    """Of the vectors of both sides with that size: the rows, the vectors, and their products in tiles (first row of either, tile)."""
    (a_ids, a_v, a_sizes), (h_ids, h_v, h_sizes) = asked, held
    a_rows, h_rows = np.flatnonzero(a_sizes == size), np.flatnonzero(h_sizes == size)
    a, h = _matrix(a_v, a_rows, size), _matrix(h_v, h_rows, size)
    left, right = _unit(a), _unit(h)

    def tiles():
        for r in range(0, len(a), ASKED):
            yield r, ((c, left[r : r + ASKED] @ right[c : c + HELD].T) for c in range(0, len(h), HELD))

    return a_rows, h_rows, a, h, tiles()


def _dealt(batches):
    """The sides of a task's rows (side, id, n, v): ids, vectors, sizes and n of either; None if one has no row."""
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None:
        return None
    side, sides = table.column("side").to_numpy(), []
    for k in (0, 1):
        mine = table.take(pa.array(np.flatnonzero(side == k)))
        if not mine.num_rows:
            return None
        v = pa.concat_arrays(mine.column("v").chunks)
        sides.append((mine.column("id").to_numpy(), v, _sizes(v), mine.column("n").to_numpy()))
    return sides


def _counting(limits: tuple[float, ...]):
    """id and, of each limit, the smallest other id from there on and the sum of the others' n, for all asked for that have others."""

    def run(batches):
        if not (sides := _dealt(batches)):
            return
        (ids, v, sizes, _), (others, w, held_sizes, weights) = sides
        least = np.full((len(limits), len(ids)), np.iinfo(np.int64).max)
        sums = np.zeros((len(limits), len(ids)), np.int64)
        for size in np.intersect1d(sizes, held_sizes[held_sizes > 0]).tolist():
            rows, held_rows, a, h, tiles = _products((ids, v, sizes), (others, w, held_sizes), size)
            for r, tile in tiles:
                for c, products in tile:
                    for k, limit in enumerate(limits):
                        i, j = np.nonzero(~(products < limit - _error(size)))  # so that what is no number is looked at
                        close = ~(products[i, j] > limit + _error(size))
                        i, j = i + r, j + c
                        keep = ids[rows[i]] != others[held_rows[j]]
                        close &= keep
                        keep[close] = ~(_cosines(a, h, i[close], j[close]) < limit)
                        if keep.any():
                            i, j = rows[i[keep]], held_rows[j[keep]]
                            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                            at = i[first]
                            least[k, at] = np.minimum(least[k, at], np.minimum.reduceat(others[j], first))
                            sums[k, at] += np.add.reduceat(weights[j], first)
        alone = len(np.unique(others)) == 1
        rows = np.flatnonzero(ids != others[0]) if alone else np.arange(len(ids))
        columns = [pa.array(ids[rows])]
        for k in range(len(limits)):
            columns += [pa.array(least[k, rows], mask=sums[k, rows] == 0), pa.array(sums[k, rows])]
        yield pa.RecordBatch.from_arrays(columns, names=["id", *(f"{name}_{k}" for k in range(len(limits)) for name in ("least", "near"))])

    return run


def _nearest(number: int):
    """id, other, similarity (in six places) of the nearest others for each id; those without a cosine come last."""

    def run(batches):
        if not (sides := _dealt(batches)):
            return
        (ids, v, sizes, _), (others, w, held_sizes, _) = sides
        few = np.zeros(len(ids), np.int64)
        for size in np.intersect1d(sizes, held_sizes[held_sizes > 0]).tolist():
            rows, held_rows, a, h, tiles = _products((ids, v, sizes), (others, w, held_sizes), size)
            for r, tile in tiles:
                found = []
                for c, products in tile:
                    same = ids[rows[r : r + len(products)], None] == others[None, held_rows[c : c + products.shape[1]]]
                    products[same] = -2
                    least = np.partition(products, -number, axis=1)[:, -number] if products.shape[1] > number else np.full(len(products), -2)
                    i, j = np.nonzero(~(products < (least - 2 * _error(size) - 1e-6)[:, None]) & ~same)
                    found.append((i + r, j + c, _rounded(_cosines(a, h, i + r, j + c))))
                i, j, s = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((others[held_rows[j]], -s, ~np.isnan(s), i))  # what is no number is the greatest
                i, j, s = i[order], j[order], s[order]
                first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
                place = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
                i, j, s = i[place < number], j[place < number], s[place < number]
                few += np.bincount(rows[i], minlength=len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows[i]]), pa.array(others[held_rows[j]]), pa.array(s)], names=["id", "other", "similarity"])
        for k in np.flatnonzero(few < number).tolist():
            rest = np.sort(others[((held_sizes != sizes[k]) | (held_sizes == 0)) & (others != ids[k])])[:number]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rest), ids[k])), pa.array(rest), pa.nulls(len(rest), pa.float64())], names=["id", "other", "similarity"])

    return run


def _against(asked: DataFrame, held: DataFrame, spread: tuple[int, int], run, schema: str) -> DataFrame:
    """``run`` over each group of ``asked`` with each of ``held``, both (id, n, v); ``spread``: into how many groups either is dealt
    where it has the rows for it, and no limit where it has more bytes than these hold."""
    groups = []
    for df, most in zip((asked, held), spread):
        rows, size = df.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        groups.append(max(1, min(most, -(-rows // WORTH)), -(-rows * max(size or 1, 1) * 8 // GROUP)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(F.lit(0).alias("side"), "id", "n", "v", own(groups[0]).alias("i"), every(groups[1]).alias("j"))
    right = held.select(F.lit(1).alias("side"), "id", "n", "v", every(groups[0]).alias("i"), own(groups[1]).alias("j"))
    both = left.unionByName(right).repartitionById(groups[0] * groups[1], F.col("i") * groups[1] + F.col("j"))
    return both.select("side", "id", "n", "v").mapInArrow(run, schema)


def _rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("vec_id").alias("id"), F.lit(1).cast("long").alias("n"), F.col("embedding").alias("v"))


def counted(asked: DataFrame, held: DataFrame, limits: list[float], spread: tuple[int, int]) -> DataFrame:
    """id, and least_k, near_k for the k-th limit: of the rows of ``held`` other than the id itself, the smallest id whose cosine is not
    below the limit (as in SQL: what is no number isn't), and the sum of their n. Ids without other rows are left out."""
    schema = "id long, " + ", ".join(f"least_{k} long, near_{k} long" for k in range(len(limits)))
    parts = _against(asked, held, spread, _counting(tuple(limits)), schema)
    return parts.groupBy("id").agg(*(f(f"{name}_{k}").alias(f"{name}_{k}") for k in range(len(limits)) for name, f in (("least", F.min), ("near", F.sum))))


def probed(base: DataFrame, queries: DataFrame, limits: list[float]) -> DataFrame:
    """counted() of the rows (vec_id, embedding) of a stated query set against all."""
    return counted(_rows(queries), _rows(base), limits, (1, 24))


def nearest(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, similarity, place: of all other rows the ``k`` nearest by cosine (in six places, then by id) for each query row."""
    found = _against(_rows(queries), _rows(base), (1, 24), _nearest(k), "id long, other long, similarity double")
    rows = ranking.top(found, "id", [F.desc("similarity"), F.col("other")], k)
    return rows.select(F.col("id").alias("query_id"), F.col("other").alias("vec_id"), "similarity", F.col("place").cast("int"))


def classes(base: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rep, n, size, v: the different vectors (vec_id, embedding), with their smallest id and how many rows have them."""
    groups = base.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double"))
    norms = groups.select("rep", "n", F.size("embedding").alias("size"), "embedding", F.sqrt(square).alias("norm")).where("norm > 0 AND norm < double('Infinity')")
    return cut(norms.select("rep", "n", "size", F.col("embedding").alias("v")))


def _farthest(sample: np.ndarray, number: int) -> np.ndarray:
    """Pivots: from the first vector on, each time the one farthest from all before."""
    chosen, best = [0], sample @ sample[0]
    while len(chosen) < min(number, len(sample)) and best.min() < 1 - 1e-9:
        chosen.append(int(best.argmin()))
        best = np.maximum(best, sample @ sample[chosen[-1]])
    return sample[chosen]


def _placed(pivots: dict[int, np.ndarray], alpha: float, probe: bool):
    """Rows (rep, n, size, v) at their cell and ring, or, as probes, at all those that may hold what is near them."""

    def run(batches):
        for batch in batches:
            sizes, flat = batch.column(2).to_numpy(), batch.column(3).flatten().to_numpy()
            starts = np.concatenate([[0], np.cumsum(sizes)])
            take, cell, ring = [], [], []
            for size in np.unique(sizes).tolist():
                rows, p = np.flatnonzero(sizes == size), pivots.get(size)
                p = np.eye(1, size) if p is None else p
                vectors = flat[(starts[rows][:, None] + np.arange(size)).ravel()].reshape(len(rows), size).astype(np.float64)
                vectors /= np.sqrt((vectors * vectors).sum(axis=1))[:, None]
                angle = np.arccos(np.clip(vectors @ p.T, -1, 1))
                nearest = angle.argmin(axis=1)
                if probe:
                    at, cells = np.nonzero(angle <= angle.min(axis=1)[:, None] + 2 * alpha + SLACK)
                    low, high = ((np.floor((angle[at, cells] + d) / alpha)).astype(int) for d in (-alpha - SLACK, alpha + SLACK))
                    for step in range(int((high - low).max()) + 1 if len(at) else 0):
                        on = low + step <= high
                        take.append(rows[at[on]]), cell.append(cells[on]), ring.append(low[on] + step)
                else:
                    take.append(rows), cell.append(nearest), ring.append(np.floor(angle[np.arange(len(rows)), nearest] / alpha).astype(int))
            if take and sum(map(len, take)):
                out = batch.take(pa.array(np.concatenate(take)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(cell), pa.int64()), pa.array(np.concatenate(ring), pa.int64())], names=[*batch.schema.names, "cell", "ring"])

    return run


def candidates(kinds: DataFrame, cosine: float, sample: int = SAMPLE, pivots: int = PIVOTS) -> DataFrame:
    """left_id, right_id, right_n, left_v, right_v of the classes that are compared; ``sample`` vectors (those with the smallest hash of
    their id) and ``pivots`` of a length are what the driver holds."""
    if not 0 < cosine < 1:
        raise ValueError("the least cosine must lie between 0 and 1")
    alpha, chosen = math.acos(cosine), {}
    by_size: dict[int, list] = {}
    for r in kinds.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("size", "v").collect():
        by_size.setdefault(r["size"], []).append(r["v"])
    for size, vectors in by_size.items():
        unit = np.array(vectors)
        chosen[size] = _farthest(unit / np.sqrt((unit * unit).sum(axis=1))[:, None], pivots)
    schema = f"rep long, n long, size int, v {kinds.schema['v'].dataType.simpleString()}, cell long, ring long"
    held = kinds.mapInArrow(_placed(chosen, alpha, False), schema).select("size", "cell", "ring", F.col("rep").alias("right_id"), F.col("n").alias("right_n"), F.col("v").alias("right_v"))
    asked = kinds.mapInArrow(_placed(chosen, alpha, True), schema).select("size", "cell", "ring", F.col("rep").alias("left_id"), F.col("v").alias("left_v"))
    return asked.join(held, ["size", "cell", "ring"]).where("left_id <> right_id")


def twins(base: DataFrame, cut: Callable[[DataFrame], DataFrame], cosine: float) -> DataFrame:
    """vec_id, twin, near: for every row the smallest other id from ``cosine`` on, and how many other rows are."""
    kinds = classes(base, cut)
    sides = kinds.select(F.col("rep").alias("id"), "n", "v")
    found = cut(counted(sides, sides, [cosine], (6, 6)).select(F.col("id").alias("rep"), F.col("least_0").alias("other"), F.col("near_0").alias("others")))
    by_class = kinds.select("rep", "n").join(found, "rep", "left")
    members = base.join(base.groupBy("embedding").agg(F.min("vec_id").alias("rep")), "embedding").select("vec_id", "rep")
    second = members.where("vec_id <> rep").groupBy("rep").agg(F.min("vec_id").alias("second"))  # for the first of a class
    rows = members.join(by_class, "rep").join(second, "rep", "left")
    own = F.when(F.col("vec_id") == F.col("rep"), F.col("second")).otherwise(F.col("rep"))
    known = rows.select("vec_id", F.least(own, "other").alias("twin"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("near"))
    return base.select("vec_id").join(known, "vec_id", "left").select("vec_id", "twin", F.coalesce("near", F.lit(0)).alias("near"))
