"""Operator 12: importance resampling of documents towards a target distribution of hashed word runs.

Each task keeps a trie of the words it meets: a node stands for a run of words, holds how often it was seen and the CRC-32 state of the
run's bytes, from which a child's state follows by its own word alone, and so has its bucket at hand. A first pass sums nodes into
buckets within the task, and only these totals (one row a bucket and task at most) are shuffled. A second pass walks the same kind of
trie with the buckets' gains attached to the nodes and sums them along each document's paths. Words are cut, numbered and
counted as arrays, a batch at a time; Python sees each distinct word of a batch once. A trie of ``most`` nodes gives its counts to the
totals and starts anew, so that memory is bounded.

The draw adds a Gumbel number, made from the document's id, to its weight; the highest sums are a sample without replacement. They are
ranked by ranges of their order, so that no task holds all rows, and the whole table of scores is written once, without texts.

Defined cases: a null text has no words; a document without features weighs 0; a null doc_id draws by the empty id and comes last among
ties, then do repeated rows in any order; empty tables give no rows, and an empty target equal counts of 0; extra columns are ignored;
texts of any length are walked whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, in_order, sliced, written

RUN, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Bytes of words are ASCII digits and letters, in lower case, and all bytes of other characters; the rest parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of texts (without nulls), the words one after the other as numbers of these, and the texts' bounds among them."""
    texts = texts.cast(pa.string())
    n, (_, bounds, data) = len(texts), texts.buffers()
    at = np.frombuffer(bounds, np.int32, n + 1, texts.offset * 4) if n else np.zeros(1, np.int32)
    plain = bytes(memoryview(data)[at[0] : at[-1]]).translate(WORD_BYTES) if data else b""
    cut = pc.split_pattern(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(plain)]), b" ")
    coded = cut.flatten().dictionary_encode()
    index, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    real = np.ones(len(index), bool)
    if b"" in names:
        real = index != names.index(b"")
    return names, index[real], np.concatenate([[0], np.cumsum(real)])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]


class WordTrie:
    """Runs of up to ``run`` words as paths from the root: per node the count, the CRC-32 state and the bucket."""

    def __init__(self, run: int, buckets: int, most: int = 1_000_000):
        self.run, self.buckets, self.most = run, buckets, most
        self.totals = np.zeros(buckets, np.int64)
        self.turn = 0  # how often the trie has started anew, which is when nodes lose their meaning
        self._empty()

    def _empty(self) -> None:
        self.first: dict[bytes, int] = {}  # the root's children
        self.child: dict[int, int] = {}  # a node and a word (as the root's child), packed
        self.word: list[bytes] = []  # of the root's children, by node
        self.crc: list[int] = []
        self.count = np.zeros(1 << 12, np.int64)

    def _node(self, crc: int, word: bytes) -> int:
        self.crc.append(crc)
        self.word.append(word)
        return len(self.crc) - 1

    def _first(self, names: list[bytes]) -> np.ndarray:
        out = np.empty(len(names), np.int64)
        for k, w in enumerate(names):
            node = self.first.get(w)
            if node is None:
                node = self.first[w] = self._node(zlib.crc32(w), w)
            out[k] = node
        return out

    def _next(self, keys: np.ndarray) -> np.ndarray:
        keys, back = np.unique(keys, return_inverse=True)
        out = np.empty(len(keys), np.int64)
        for k, key in enumerate(keys.tolist()):
            node = self.child.get(key)
            if node is None:
                word = self.word[key & 0xFFFFFFFF]
                node = self.child[key] = self._node(zlib.crc32(b" " + word, self.crc[key >> 32]), word)
            out[k] = node
        return out[back]

    def walk(self, texts: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The texts' numbers of words; for each length of runs, their nodes and the texts' bounds among these."""
        if len(self.crc) > self.most:
            self.flush()
        names, index, bounds = words(texts)
        first = self._first(names)[index] if len(names) else np.zeros(0, np.int64)
        levels, nodes = [(first, bounds)], first
        for n in range(2, self.run + 1):
            lengths = np.maximum(np.diff(bounds) - n + 1, 0)
            ends = np.cumsum(lengths)
            at = np.repeat(bounds[:-1] - ends + lengths, lengths) + np.arange(lengths.sum())  # where runs of n words begin
            before = levels[-1][1][:-1]  # the runs of n - 1 words, numbered by text
            nodes = self._next(nodes[np.repeat(before - ends + lengths, lengths) + np.arange(lengths.sum())] << 32 | first[at + n - 1])
            levels.append((nodes, np.concatenate([[0], ends])))
        return np.diff(bounds), levels

    def bucket(self) -> np.ndarray:
        return np.array(self.crc, np.int64) % self.buckets

    def add(self, texts: pa.Array) -> None:
        """Counts the texts' runs."""
        for nodes, _ in self.walk(texts)[1]:
            if len(self.count) < len(self.crc):
                self.count = np.concatenate([self.count, np.zeros(max(len(self.crc), len(self.count)), np.int64)])
            self.count += np.bincount(nodes, minlength=len(self.count))

    def flush(self) -> np.ndarray:
        """The buckets' totals so far; the trie starts anew. Nodes that were walked but never counted have no counts."""
        counted = min(len(self.crc), len(self.count))
        np.add.at(self.totals, self.bucket()[:counted], self.count[:counted])
        self.turn += 1
        self._empty()
        return self.totals


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("text", F.lit("")).alias("text"))


def bucket_counts(docs: DataFrame, run: int = RUN, buckets: int = BUCKETS, most: int = 1_000_000) -> DataFrame:
    """bucket, n: how many features of all texts fall into the buckets that have any."""

    def count(batches):
        trie = WordTrie(run, buckets, most)
        for batch in batches:
            for part in sliced(batch, 5000):
                trie.add(part.column(0))
        totals = trie.flush()
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(totals[used])], names=["bucket", "n"])

    return texts_of(docs).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, spark: SparkSession, buckets: int = BUCKETS) -> list[int]:
    """The buckets' gains, from (bucket, n) of both sides: floor(1000 ln of the smoothed ratio of shares). ``buckets`` bounds the list."""
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0)
    rows = written(both, "bucket-counts")
    s, t = rows.agg(F.sum("s"), F.sum("t")).first()
    plus = lambda c, k: F.col(c).cast("double") + F.lit(float(k))
    ratio = plus("t", 1) * F.lit(float(s + buckets)) / (plus("s", 1) * F.lit(float(t + buckets)))
    found = rows.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))
    return [r["gain"] for r in found.sort("bucket").collect()]


def weights(docs: DataFrame, gain: list[int], run: int = RUN, most: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of ``docs``: the floored mean of its features' gains."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(np.array(gain, np.int64))  # one number a bucket

    def walk(batches):
        trie, attached, turn = WordTrie(run, len(table.value), most), np.zeros(0, np.int64), 0
        for batch in batches:
            for part in sliced(batch, 5000):
                n_words, levels = trie.walk(part.column(1))
                if turn != trie.turn:
                    attached, turn = np.zeros(0, np.int64), trie.turn
                new = np.array(trie.crc[len(attached) :], np.int64) % len(table.value)
                attached = np.concatenate([attached, table.value[new]])
                total, number = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
                for nodes, bounds in levels:
                    sums = np.concatenate([[0], np.cumsum(attached[nodes])])
                    total += sums[bounds[1:]] - sums[bounds[:-1]]
                    number += np.diff(bounds)
                weight = total // np.maximum(number, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(number), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(walk, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, most: int = 1_000_000) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs`` (doc_id, text), towards ``target`` (text).

    Of the documents with ``least_words`` words or more ``percent`` of a hundred are drawn, those with the highest scores; others have no rank.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, run, buckets, most), bucket_counts(target, run, buckets, most), spark, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))
    weighed = written(weights(docs, gain, run, most), "resample-weights")  # ranges are sampled before they are dealt: texts are walked once
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("short", F.col("n_words") < least_words)
    ordered = in_order(scored, ["short", F.desc("score"), F.col("doc_id").asc_nulls_last()], "at")
    number = ordered.where(~F.col("short")).count()
    drawn = F.when(~F.col("short") & (F.col("at") < percent * number // 100), F.col("at") + 1)
    return ordered.select("doc_id", "n_features", "weight", "score", drawn.cast("long").alias("rank"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
dw AS (SELECT r, unnest(words) AS w FROM d), bw AS (SELECT unnest(words) AS w FROM b),
seen AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)), lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM seen, crc_table),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000.0::DOUBLE * ln((coalesce(t, 0)::DOUBLE + 1) * (SELECT count(*) + 10000 FROM dw)::DOUBLE / ((s::DOUBLE + 1) * (SELECT count(*) + 10000 FROM bw)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN hashed USING (w) JOIN g USING (bucket) GROUP BY r),
z AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || sha256('2024:' || d.doc_id)[1:8])::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN m USING (r)),
o AS (SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS drawable FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * drawable // 100 THEN place END AS rank FROM o
"""
