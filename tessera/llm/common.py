"""What the text operators share: tables, the shared scratch folder, Arrow mapping and word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it (bytes 32 and 9 to 13).
SPACE = r"[\x20\x09-\x0D]+"
MOST_BITS = 1 << 28


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); where none is set, a temporary one, but only
    for a local session, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: lineage ends here and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _placed(rows: DataFrame, keys: DataFrame, key: str, number: int) -> tuple[DataFrame, DataFrame, Column]:
    """Rows with the place of their key in a bitmap, the bitmap of ``keys``, and whether a row's place is marked there."""
    bits = min(1 << max(16 * number - 1, 1).bit_length(), MOST_BITS)
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    marks = keys.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    placed = rows.select("*", F.bitmap_bucket_number(at).alias("_bucket"), F.bitmap_bit_position(at).alias("_place"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return placed, F.broadcast(marks), byte.bitwiseAND(F.expr("shiftleft(1, cast(_place % 8 as int))")) > 0


def perhaps_in(rows: DataFrame, keys: DataFrame, key: str, number: int) -> DataFrame:
    """The rows of ``rows`` whose ``key`` may be among ``keys`` (all that are, few others), left where they lie.

    ``number`` keys are hashed to a bitmap of 16 bits each, ``MOST_BITS`` at most, which is what bounds the broadcast (32 MB);
    beyond, more rows pass that aren't among the keys.
    """
    placed, marks, marked = _placed(rows, keys, key, number)
    return placed.join(marks, "_bucket").where(marked).select(*rows.columns)


def not_in(rows: DataFrame, keys: DataFrame, key: str, number: int) -> DataFrame:
    """The rows of ``rows`` whose ``key`` (never null) is not among ``keys`` (distinct): those that the bitmap of perhaps_in clears
    stay where they lie, only the others are joined."""
    placed, marks, marked = _placed(rows, keys, key, number)
    clear = placed.join(marks, "_bucket", "left").where(~F.coalesce(marked, F.lit(False))).select(*rows.columns)
    # an anti join would be pushed below the bitmap and shuffle all rows
    others = perhaps_in(rows, keys, key, number).join(keys.select(key, F.lit(True).alias("_in")), key, "left").where("_in IS NULL")
    return clear.unionByName(others.select(*rows.columns))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def sliced(batch: pa.RecordBatch, rows: int = 1000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows and some ``size`` bytes of texts, binaries and lists; a longer row comes alone."""
    cost = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            cost += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        elif pa.types.is_list(column.type):
            cost += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.concatenate([[0], np.cumsum(cost)]), 0
    while at < batch.num_rows:
        to = max(min(at + rows, int(np.searchsorted(total, total[at] + size, side="right")) - 1), at + 1)
        yield batch.slice(at, to - at)
        at = to


def arrow_map(df: DataFrame, make: Callable[[], Callable[..., dict[str, pa.Array]]], schema: str, rows: int = 1000) -> DataFrame:
    """mapInArrow in slices of ``rows`` and bounded bytes. ``make`` runs once a task and returns a function from the columns (as
    lists) to a dict of Arrow arrays in the order of ``schema``."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in sliced(batch, rows):
                out = step(**{n: part.column(i).to_pylist() for i, n in enumerate(names)})
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return df.mapInArrow(run, schema)


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


class WordTable:
    """What words stand for, as stretches of one array: a table that grows by the words that texts bring anew, up to ``most``.

    ``make`` gives for a list of new words one array, and where in it each word's stretch begins and how long it is. Texts are
    looked up a batch at a time: words are numbered by Arrow's dictionary, so that Python sees every distinct word of a batch once.
    """

    def __init__(self, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], dtype, most: int = 300_000):
        self.make, self.dtype, self.most = make, dtype, most
        self._empty()

    def _empty(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.empty(1 << 16, self.dtype), np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)
        self.used = 0

    def rows(self, words: list[str]) -> np.ndarray:
        """The rows of distinct words in ``starts`` and ``lengths``; valid until the next call."""
        new = [w for w in words if w not in self.number]
        if len(self.number) + len(new) > self.most:
            self._empty()
            new = words
        if new:
            flat, starts, lengths = self.make(new)
            first, last = len(self.number), len(self.number) + len(new)
            self.number.update(zip(new, range(first, last)))
            self.flat = _room(self.flat, self.used, self.used + len(flat))
            self.starts, self.lengths = (_room(x, first, last) for x in (self.starts, self.lengths))
            self.flat[self.used : self.used + len(flat)] = flat
            self.starts[first:last], self.lengths[first:last] = starts + self.used, lengths
            self.used += len(flat)
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """What the words of texts stand for, cut at single blanks: one array for all texts and the texts' ends in it."""
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        row = self.rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        lengths = self.lengths[row]
        return gathered(self.flat, self.starts[row], lengths), np.concatenate([[0], np.cumsum(lengths)])[offsets]


def _room(x: np.ndarray, used: int, need: int) -> np.ndarray:
    if need <= len(x):
        return x
    more = np.empty(max(need, 2 * len(x)), x.dtype)
    more[:used] = x[:used]
    return more


class Memo(dict):
    """A dict that fills itself by ``make`` and starts anew beyond ``most`` entries, so that a worker's memory is bounded."""

    def __init__(self, make: Callable, most: int = 200_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def sampled_labels(spark: SparkSession, sf_dir: str, column: str, folds: int, held: int, most: int) -> DataFrame:
    """At most ``most`` labelled rows (doc_id, label) outside the held-out fold, those with the smallest hash of their id.

    ``most`` is what bounds the result, so that it can be broadcast.
    """
    rows = labels(spark, sf_dir).where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
    rows = rows.where(fold(F.col("doc_id"), folds) != held).select("doc_id", F.col(column).cast("int").alias("label"))
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def logistic_fit(x, y) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic model by Newton's method with a weak ridge; without two classes the
    offset alone, at the smoothed rate."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    rate = (y.sum() + 1.0) / (len(y) + 2.0)
    w = np.array([0.0, np.log(rate / (1 - rate))])
    if len(set(y)) < 2:
        return 0.0, float(w[1])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -35, 35)))
        grad = design.T @ (p - y) + 1e-3 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def in_order(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with their number from 0 in an order, as ``name``: they are dealt by ranges of it, numbered there, and written.

    What the driver holds and broadcasts is one count a partition.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    dealt, part = written(dealt, "in-order"), F.shiftright(name, 33)
    before, total = [], 0
    for r in sorted(dealt.groupBy(part.alias("part")).count().collect()):
        before.append((r["part"], total))
        total += r["count"]
    firsts = F.broadcast(spark.createDataFrame(before, "_part long, _before long"))
    inside = F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    columns = [F.col(c) for c in rows.columns]
    return dealt.withColumn("_part", part).join(firsts, "_part").select(*columns, (inside + F.col("_before")).alias(name))
