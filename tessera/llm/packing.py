"""Operator 5: best-fit packing of token sequences by linear grouping.

Documents are tokenised once; only what packing needs (lengths and checksums of pieces) is kept. Lengths are at most
``CAPACITY``, so their histogram is bounded, and the whole plan is made from it: lengths above ``CAPACITY / 8`` are put in
``GROUPS`` groups of equal cardinality, each rounded up to its longest; the few sizes that result are packed by the
configuration linear programme (column generation with a knapsack for pricing), rounded down, the rest greedily; actual
lengths then take the places of the rounded ones, longest first; short pieces are best-fit into the gaps this leaves, and
into new sequences after that. The plan says for every length which ranks go to which sequences, as a few thousand
intervals, whatever the number of documents.

Ranks of a length are given without gathering it: every task numbers its own pieces by length, and a running sum over
the tasks' counts turns these into ranks. A hot length is thus spread like any other.

Defined cases: null and empty texts are a single end token; a repeated doc_id is packed like any other row; an empty
table gives no rows; texts of any length are cut into pieces of ``CAPACITY`` with the shorter one first; extra columns are
ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import documents, sliced, written

CAPACITY, END, GROUPS = 1024, 2, 96


#: Texts of these characters alone, without a long word, are cut into words alike by every version of the Unicode tables.
PLAIN = re.compile(r"[\0-\u024f\u2010-\u2027]*")
LONG_WORD = re.compile(r"\S{400}")


def merge_ranks(path: str) -> dict[bytes, int]:
    """The tokenizer file's vocabulary as bytes with their ids, which rise in the order of merges."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as themselves
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    return {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if all(c in byte_of for c in t)}


@lru_cache(2)
def token_ids(path: str):
    """A function from texts to their ids, as the ``tokenizers`` library gives them; one object a worker.

    Plain texts are encoded by ``tiktoken`` with the ranks of the same file, which gives the same ids (tested over all plain
    characters) in a quarter of the time; others, and those with a special token (such as ``<|endoftext|>``, which in a text is
    that token), by ``tokenizers`` itself.
    """
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    ranks = {t: i for t, i in merge_ranks(path).items() if t.decode("utf-8", "replace") not in special}
    quick = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[np.ndarray]:
        apart = [k for k, t in enumerate(texts) if not PLAIN.fullmatch(t) or LONG_WORD.search(t) or any(x in t for x in special)]
        whole = dict(zip(apart, tokenizer.encode_batch_fast([texts[k] for k in apart], add_special_tokens=False)))
        return [np.array(whole[k].ids, "<u4") if k in whole else np.asarray(quick.encode_ordinary(t), "<u4") for k, t in enumerate(texts)]

    return encode


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and (part, seq): the piece's number among those of its length in its task."""

    def cut(batches):
        encode, part, count = token_ids(path or tokenizer_path()), TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([END], "<u4").tobytes()
        for batch in chain.from_iterable(sliced(b) for b in batches):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()])):
                ids = memoryview(ids.tobytes() + end)
                n = len(ids) // 4
                start, to = 0, n % capacity or min(n, capacity)
                for piece in range(-(-n // capacity)):
                    length = to - start
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * to]), part, count[length]))
                    count[length] += 1
                    start, to = to, to + capacity
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "seq"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, seq long")


def best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits: an unbounded knapsack."""
    value, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= c)
        gain = value[c - sizes[fits]] + prices[fits]
        k = int(gain.argmax())
        if gain[k] > value[c - 1] + 1e-12:
            value[c], take[c] = gain[k], fits[k]
        else:
            value[c], take[c] = value[c - 1], -1
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            pattern[take[c]] += 1
            c -= int(sizes[take[c]])
    return float(value[capacity]), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 1500) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that cover the demand exactly: the rounded-down configuration programme, then greedy ones."""
    m, out = len(sizes), []
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.linalg.inv(basis)
    amount = inverse @ demand
    for step in range(rounds):
        value, pattern = best_pattern(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ pattern
        ratio = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(ratio.argmin())
        basis[:, leave] = pattern
        if step % 50 == 49:
            inverse = np.linalg.inv(basis)
            amount = np.maximum(inverse @ demand, 0)
        else:
            amount = np.maximum(amount - ratio[leave] * direction, 0)
            amount[leave] = ratio[leave]
            row = inverse[leave] / direction[leave]
            inverse = inverse - np.outer(direction, row)
            inverse[leave] = row
    left = demand.astype(np.int64).copy()
    for column, times in zip(basis.T.round().astype(np.int64), np.floor(amount + 1e-6).astype(np.int64)):
        used = column > 0
        times = min(int(times), int((left[used] // column[used]).min()))
        if times > 0:
            out.append((column, times))
            left -= times * column
    while left.any():
        pattern, room = np.zeros(m, np.int64), capacity
        for i in range(m):  # from the longest
            pattern[i] = min(left[i], room // sizes[i])
            room -= int(pattern[i] * sizes[i])
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        out.append((pattern, times))
        left -= times * pattern
    return out


class Plan:
    """For every length, intervals of ranks: from rank ``a`` on, sequences from ``base`` on, at ``offset``."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS):
        self.capacity, self.sequences = capacity, 0
        self.at: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        self.used: dict[int, int] = defaultdict(int)
        gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
        large = sorted((n for n in counts if n > capacity // 8), reverse=True)
        self._large([(n, counts[n]) for n in large], groups, gaps)
        self._small(sorted((n for n in counts if n <= capacity // 8), reverse=True), counts, gaps)

    def _put(self, length: int, base: int, number: int, offset: int) -> None:
        self.at[length].append((self.used[length], base, offset))
        self.used[length] += number

    def _open(self, number: int) -> int:
        self.sequences += number
        return self.sequences - number

    def _large(self, runs, groups, gaps) -> None:
        total = sum(c for _, c in runs)
        if not total:
            return
        bounds = [total * (g + 1) // groups for g in range(groups)]
        queues: dict[int, list[list[int]]] = defaultdict(list)  # by rounded size: lengths and their numbers, longest first
        g, done, size = 0, 0, None
        for length, count in runs:
            while count:
                while bounds[g] <= done:
                    g, size = g + 1, None
                size = size or length
                n = min(count, bounds[g] - done)
                queues[size].append([length, n])
                done, count = done + n, count - n
        sizes = np.array(sorted(queues, reverse=True))
        demand = np.array([sum(n for _, n in queues[s]) for s in sizes.tolist()])
        for pattern, times in configurations(sizes, demand, self.capacity):
            slots = [int(sizes[i]) for i in np.flatnonzero(pattern) for _ in range(pattern[i])]
            filled = []
            for s in slots:
                need, got = times, []
                while need:
                    run = queues[s][0]
                    n = min(need, run[1])
                    got.append((run[0], n))
                    need, run[1] = need - n, run[1] - n
                    if not run[1]:
                        queues[s].pop(0)
                filled.append(got)
            base, ends = self._open(times), sorted({e for got in filled for e in np.cumsum([n for _, n in got]).tolist()})
            pointer, left = [0] * len(slots), [got[0][1] for got in filled]
            at = 0
            for end in ends:  # within such a stretch each slot has one length
                offset = 0
                for k, got in enumerate(filled):
                    self._put(got[pointer[k]][0], base + at, end - at, offset)
                    offset += got[pointer[k]][0]
                    left[k] -= end - at
                    if not left[k] and pointer[k] + 1 < len(got):
                        pointer[k] += 1
                        left[k] = got[pointer[k]][1]
                gaps[self.capacity - offset].append((base + at, end - at))
                at = end

    def _small(self, lengths, counts, gaps) -> None:
        for length in lengths:
            n = counts[length]
            while n:
                room = next((r for r in range(length, self.capacity + 1) if gaps.get(r)), None)
                if room is None:
                    each = self.capacity // length
                    number = max(n // each, 1)
                    room = self.capacity
                    gaps[room].append((self._open(number), number))
                base, number = gaps[room].pop()
                if n < number:
                    gaps[room].append((base + n, number - n))
                    number = n
                times = min(room // length, n // number)
                for t in range(times):
                    self._put(length, base, number, self.capacity - room + t * length)
                n -= times * number
                if room > times * length:
                    gaps[room - times * length].append((base, number))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence_id and offset of pieces by length and rank."""
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length).tolist():
            rows, table = np.flatnonzero(length == n), np.array(self.at[n], np.int64)
            k = np.searchsorted(table[:, 0], rank[rows], side="right") - 1
            sequence[rows] = table[k, 1] + rank[rows] - table[k, 0]
            offset[rows] = table[k, 2]
        return sequence, offset


def ranked(cut: DataFrame) -> DataFrame:
    """The pieces with their rank among those of their length: their number in their task after all earlier tasks' counts."""
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return cut.join(before, ["length", "part"]).withColumn("rank", F.col("seq") + F.col("before")).drop("seq", "part", "before")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs`` (doc_id, text)."""
    cut = written(pieces(docs, path, capacity), "pack-pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().toLocalIterator()}  # at most CAPACITY rows
    plan = docs.sparkSession.sparkContext.broadcast(Plan(counts, capacity, groups))

    def place(batches):
        for batch in batches:
            sequence, offset = plan.value.place(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    rows = ranked(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return rows.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of the documents."""
    return pack(docs)
