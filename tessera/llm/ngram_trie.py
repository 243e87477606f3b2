"""Operator 7: language-model scores from an Elias-Fano n-gram trie.

The model pools the counts of all orders up to ``order`` over a Dirichlet prior (for bigrams, that of MacKay and Peto). For order 3,
p(w | u v) = (LIFT * c(u v w) + c(v w) + MASS * p(w)) / (LIFT * c(u v) + c(v) + MASS), where p(w) is add-one over all training
tokens and c(u v) and c(v) count what is followed by a word; order 2 leaves out the LIFT terms, and each further order has LIFT
times the weight of the one below. It sums to 1 over the vocabulary and one unknown word. The end token of a document also
stands (as often as the order asks for) before its first word.

The trie is kept by shards of the predicted word. In a shard, level 1 holds its words, level 2 for every word w the words v that
stood before it, level 3 for every v w the words u before those, and so on, as numbers relative to the node's own range: the
numbers of a range are raised by the last one of the range before, which makes the level monotone. All levels and the pointers between them are Elias-Fano sequences; smoothed log-probabilities
are quantised to ``1 / STEPS``. A shard's levels lie in one memory-mapped file (unlinked at once, in the task's own temporary folder), and are
queried by successor search in the range that a node's pointers give, from a context to the one that is longer by a word.

A text's score is the sum over tokens of the logarithm of the numerator, known where w is, and of that of the denominator, known
where v is, as c(u v) is a count of v's own trie. Every token is once predicted and once ends the context of another, so that each shard adds up what it knows by document and only these sums are
sent back, as whole numbers. A first pass counts all words. Words with a third of a shard's tokens are dealt over all shards by the
word before them, pairs and longer sequences of them with as many by what stands before these, and full sequences by their batch;
their counts are taken from further passes. So no key fills a shard; the number of shards follows the number of tokens.

Words are known by 64-bit hashes, as context by 40 bits of these. Nothing is pruned or capped. Memory a task: some 200 bytes for each of
``SHARD_TOKENS`` tokens at order 3.

Defined cases: null and empty texts consist of the end token; without training rows all counts are 0; repeated rows count
and are scored each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import mmap
import tempfile
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, fold, written
from tessera.llm.near_dedup import mix

FOLDS, HELD, MASS, STEPS = 7, 2, 300.0, 1024
ORDER, LIFT = 3, 10.0
SHARD_TOKENS, BATCH_TOKENS, COUNT_TOKENS = 800_000, 4_500_000, 2_000_000
BASE_STEPS = 1 << 32  # base scores travel as whole numbers of these
END = xxhash.xxh3_64_intdigest(b"\n")  # no word has a line feed


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words and the end token."""
    words = (text or "").encode().lower().split()
    out = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.append(out, np.uint64(END))


# --- Elias-Fano sequences, in numpy ------------------------------------------------------------------------------------

_IN_BYTE = np.full((256, 9), 8, np.uint8)  # _IN_BYTE[b, k]: place of the k-th one bit of a byte
for _b in range(256):
    _ones = [i for i in range(8) if _b >> i & 1]
    _IN_BYTE[_b, : len(_ones)] = _ones
_COUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class EliasFano:
    """A monotone sequence of 64-bit numbers: low bits packed, high parts in unary. Works on buffers, so on mapped files."""

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray):
        self.n, self.low, self.lows, self.highs = n, low, lows, highs
        self.ones = np.concatenate([[0], np.cumsum(_COUNT[highs], dtype=np.int64)])
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 8 - self.ones

    @staticmethod
    def encode(values: np.ndarray) -> tuple[tuple[int, int], np.ndarray, np.ndarray]:
        """(n, low bits), packed low bits and unary high bits as bytes."""
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = max((top // max(n, 1)).bit_length() - 1, 0)
        place = np.arange(n, dtype=np.uint64) * np.uint64(low)
        word, shift = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
        part = values & np.uint64((1 << low) - 1)
        lows = np.zeros(n * low // 64 + 2, np.uint64)
        if low:
            np.bitwise_or.at(lows, word, part << shift)
            over = shift + np.uint64(low) > np.uint64(64)
            np.bitwise_or.at(lows, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        bits = np.zeros((top >> low) + n + 9, np.uint8)
        bits[(values >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
        return (n, low), lows.view(np.uint8), np.packbits(bits, bitorder="little")

    def _select(self, k: np.ndarray, counts: np.ndarray, flip: int) -> np.ndarray:
        byte = np.searchsorted(counts, k, side="right") - 1
        return byte * 8 + _IN_BYTE[self.highs[byte] ^ np.uint8(flip), k - counts[byte]].astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        place = i.astype(np.uint64) * np.uint64(self.low)
        word, shift = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
        out = self.lows[word] >> shift
        over = shift > 0
        out[over] |= self.lows[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        high = self._select(i, self.ones, 0) - i
        return high.astype(np.uint64) << np.uint64(self.low) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The place of the first element that is not less than x."""
        high = (x >> np.uint64(self.low)).astype(np.int64)
        last = self.zeros[-1] - 1
        high = np.minimum(high, last)
        at = np.where(high > 0, self._select(np.maximum(high - 1, 0), self.zeros, 255) - (high - 1), 0)
        stop = self._select(high, self.zeros, 255) - high
        want = x & np.uint64((1 << self.low) - 1)
        todo = np.flatnonzero(at < stop)
        first, after, want = at[todo], stop[todo], want[todo]
        while len(todo):  # a binary search among the elements of equal high bits
            middle = (first + after) >> 1
            less = self._low(middle) < want
            first, after = np.where(less, middle + 1, first), np.where(less, after, middle)
            at[todo] = first
            go = first < after
            todo, first, after, want = todo[go], first[go], after[go], want[go]
        return at


# --- the trie of a shard ------------------------------------------------------------------------------------------------


class Trie:
    """Levels in one memory-mapped file: words, pointers, the words before them, counts and quantised log-probabilities."""

    def __init__(self, words, counts, children, before, pair_counts, floor: float, total: float, further=()):
        """``children``: how many words before each word; ``before``: their hashes, by word and ascending; ``floor``: add-one's
        share of an unknown word; ``total``: its denominator; ``further``: (children, before, counts) of each longer context."""
        below = [(children, before, pair_counts), *further]
        ids, place = np.unique(np.concatenate([b for _, b, _ in below]), return_inverse=True)
        places = np.split(place, np.cumsum([len(b) for _, b, _ in below])[:-1])
        value = prior = MASS * (counts + floor) / total
        is_end = words == END
        # the end token stands before a text's first word with end tokens alone before it, whatever word it came after
        context = MASS + counts * np.where(is_end, sum(LIFT**d for d in range(len(below))), 1.0)
        parts = {"words": EliasFano.encode(words), "ids": EliasFano.encode(ids)}
        arrays = {"counts": np.asarray(counts, "<i8"), "alone": quantised(np.log10(prior)), "context.0": quantised(-np.log10(context))}
        for d, ((children, _, n), at) in enumerate(zip(below, places)):
            pointers, level = relative(children, at)
            parts |= {f"pointers.{d}": EliasFano.encode(pointers), f"level.{d}": EliasFano.encode(level)}
            value = LIFT**d * n + np.repeat(value, children)
            arrays[f"grams.{d}"] = quantised(np.log10(value))
            if d + 1 < len(below):
                is_end = np.repeat(is_end, children)
                context = np.repeat(context, children) + np.where(is_end, 0.0, LIFT ** (d + 1) * n)
                arrays[f"context.{d + 1}"] = quantised(-np.log10(context))
        self.file = tempfile.TemporaryFile()
        where = {}
        for name, data in chain(((f"{k}.{j}", p[j + 1]) for k, p in parts.items() for j in (0, 1)), arrays.items()):
            self.file.write(b"\0" * (-self.file.tell() % 8))
            where[name] = (self.file.tell(), data.dtype, len(data))
            self.file.write(data.tobytes())
        self.file.write(b"\0" * 8)
        self.file.flush()
        self.size = self.file.tell()
        mapped = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        view = {k: np.frombuffer(mapped, t, n, at) for k, (at, t, n) in where.items()}
        got = {k: EliasFano(*p[0], view[f"{k}.0"].view(np.uint64), view[f"{k}.1"]) for k, p in parts.items()}
        self.words, self.ids, self.counts, self.alone = got["words"], got["ids"], view["counts"], view["alone"]
        self.levels = [(got[f"pointers.{d}"], got[f"level.{d}"], view[f"grams.{d}"]) for d in range(len(below))]
        self.contexts = [view[f"context.{d}"] for d in range(len(below))]
        self.unknown = float(np.log10(MASS * floor / total))

    def find(self, words: np.ndarray) -> np.ndarray:
        """Their nodes, -1 for none."""
        if not self.words.n:
            return np.full(len(words), -1)
        at = np.minimum(self.words.successor(words), self.words.n - 1)
        return np.where(self.words.get(at) == words, at, -1)

    def pair(self, node: np.ndarray, *before: np.ndarray) -> np.ndarray:
        """log10 of the numerator of word nodes and the hashes of the words before, the nearest first."""
        return self.grams(node, *before)[0]

    def grams(self, node: np.ndarray, *before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the numerator and -log10 of the denominator for which the word ends the context, of word nodes and the
        hashes of the words before, the nearest first; both come from the longest sequence that the trie knows."""
        out, context = np.full(len(node), self.unknown), np.full(len(node), -np.log10(MASS))
        ask = np.flatnonzero(node >= 0)
        node = node[ask]
        if len(ask):
            out[ask], context[ask] = self.alone[node] / STEPS, self.contexts[0][node] / STEPS
        for d, ((pointers, level, grams), hashes) in enumerate(zip(self.levels, before), 1):
            if not level.n or not len(ask):
                break
            words, each = np.unique(hashes[ask], return_inverse=True)  # each context word is looked up once, in order
            at = np.minimum(self.ids.successor(words), self.ids.n - 1)
            known, at = (self.ids.get(at) == words)[each], at[each]
            ask, node, at = ask[known], node[known], at[known]
            first, stop = pointers.get(node).astype(np.int64), pointers.get(node + 1).astype(np.int64)
            base = np.where(first > 0, level.get(np.maximum(first - 1, 0)), np.uint64(0))
            key = base + at.astype(np.uint64) + np.uint64(1)
            got = level.successor(key)
            inside = np.flatnonzero(got < stop)
            hit = inside[level.get(got[inside]) == key[inside]]
            ask, node = ask[hit], got[hit]
            out[ask] = grams[node] / STEPS
            if d < len(self.contexts):
                context[ask] = self.contexts[d][node] / STEPS
        return out, context


def relative(children: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers and level of the numbers ``place``, ascending in the range of each parent, made monotone over all ranges."""
    pointers = np.concatenate([[0], np.cumsum(children)]).astype(np.uint64)
    ends = np.flatnonzero(children)
    raise_by = np.zeros(len(children), np.uint64)
    lasts = place[pointers[1:][ends].astype(np.int64) - 1].astype(np.uint64) + np.uint64(1)
    raise_by[ends] = np.concatenate([[0], np.cumsum(lasts)[:-1]]).astype(np.uint64)
    return pointers, np.repeat(raise_by, children) + place.astype(np.uint64) + np.uint64(1)


def quantised(x: np.ndarray) -> np.ndarray:
    return np.round(np.asarray(x) * STEPS).astype("<i2")


# --- Spark jobs ---------------------------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; the bytes of integers are put plane by plane, as most of the upper ones are 0."""
    out = []
    for a in arrays:
        raw = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
        data = pa.compress(raw, codec="zstd", asbytes=True)
        out.append(np.array([len(a), len(data)], "<i8").tobytes() + a.dtype.str.encode().ljust(8) + data)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, size = np.frombuffer(data, "<i8", 2, at).tolist()
        kind = np.dtype(data[at + 16 : at + 24].decode().strip())
        raw = pa.decompress(data[at + 24 : at + 24 + size], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True)
        out.append(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).reshape(-1))
        at += 24 + size
    return out


def training(docs: DataFrame) -> DataFrame:
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False))
    return docs.where(~held).select("text")


def in_batches(batches, most: int):
    """The tokens of texts, ``most`` or some more at a time: an end token, then the texts, each with its own."""
    held, size = [np.array([END], np.uint64)], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.append(tokens(text))
            size += len(held[-1])
            if size >= most:
                yield np.concatenate(held)
                held, size = held[:1], 0
    if size:
        yield np.concatenate(held)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the training counts of all words, combined a batch at a time before the shuffle."""

    def count(batches):
        for word in in_batches(batches, COUNT_TOKENS):
            word, n = np.unique(word[1:], return_counts=True)
            yield pa.RecordBatch.from_arrays([as_long(word), pa.array(n.astype(np.int32))], names=["word", "n"])

    return written(training(docs).mapInArrow(count, "word long, n int").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")


def context(word: np.ndarray) -> np.ndarray:
    """What words are known by as context: 40 bits."""
    return word >> np.uint64(24)


def longer(gram: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The hash of a sequence with one more word before it."""
    return mix(gram * np.uint64(0x9E3779B97F4A7C15) + before)


def befores(word: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """The ``order - 1`` words before those at ``at`` + 1, the nearest first; before a text's first word stand end tokens alone."""
    out = [word[at]]
    for k in range(1, order - 1):
        out.append(np.where(out[-1] == END, np.uint64(END), word[np.maximum(at - k, 0)]))
    return out


class Hot:
    """Sequences of one to ``order`` words with so many occurrences that they would fill a shard: by length, hashes and training counts."""

    def __init__(self, levels: list[dict[int, int]]):
        self.levels = []
        for level in levels:
            hashes = np.array(list(level), np.int64).view(np.uint64)
            by = np.argsort(hashes)
            self.levels.append((hashes[by], np.array(list(level.values()), np.int64)[by]))

    def counts(self, d: int, grams: np.ndarray) -> np.ndarray:
        """The training counts of hot sequences, -1 for others."""
        hashes, n = self.levels[d]
        if not len(hashes):
            return np.full(len(grams), -1)
        at = np.minimum(np.searchsorted(hashes, grams), len(hashes) - 1)
        return np.where(hashes[at] == grams, n[at], -1)


def hot_sequences(docs: DataFrame, words: DataFrame, order: int, shard_tokens: int) -> Hot:
    """What is hot has as many training occurrences as a third of a shard, so that its number is bounded by that of the shards;
    a hot sequence consists of hot words, and is counted exactly in one more pass over the texts for each length that has any."""
    least = max(shard_tokens // 3, 1)
    single = {r["word"]: r["n"] for r in words.where(F.col("n") >= least).toLocalIterator()}
    if not single:
        return Hot([{}] * order)
    ones = Hot([single])

    levels = [single]
    while len(levels) < order and levels[-1]:  # a hot sequence begins with a hot one that is a word shorter
        got = Hot([*levels, *[{}] * (order - len(levels))])

        def count(batches, d=len(levels), got=got):
            for word in in_batches(batches, COUNT_TOKENS):
                at = np.arange(len(word) - 1, dtype=np.int32)
                gram = word[1:]
                for k in range(d):
                    hot = got.counts(k, gram) >= 0
                    at, gram = at[hot], gram[hot]
                    before = befores(word, at, k + 2)[k]
                    hot = ones.counts(0, before) >= 0
                    at, gram = at[hot], longer(gram[hot], context(before[hot]))
                gram, n = np.unique(gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([as_long(gram), pa.array(n.astype(np.int32))], names=["gram", "n"])

        found = training(docs).mapInArrow(count, "gram long, n int").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        levels.append({r["gram"]: r["n"] for r in found.toLocalIterator()})  # at most three for each shard
    return Hot(levels + [{}] * (order - len(levels)))


def route(docs: DataFrame, shards: int, hot: Hot, order: int) -> DataFrame:
    """A row for each batch of texts and shard: the shard's words there, the ``order - 1`` words before them, and whose they are; and one
    for each batch with its documents, under a negative shard. Hot words are dealt by the word before them as well, hot pairs by the
    one before these, and so on; hot sequences of full length by their batch."""

    def deal(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, held, texts, size = [], [], [], 0

        def flush():
            batch = part << 24 | number
            n = np.array([len(t) for t in texts], np.int64)
            word = np.concatenate([np.array([END], np.uint64), *texts])  # word[i] stands before word[i + 1]: each text ends with END
            texts.clear()
            owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
            place = word[1:].copy()
            gram = place
            at = np.arange(len(place), dtype=np.int32)
            for d in range(order):
                is_hot = hot.counts(d, gram) >= 0
                at, gram = at[is_hot], gram[is_hot]
                if not len(at):
                    break
                gram = longer(gram, context(befores(word, at, d + 2)[d]) if d + 1 < order else np.uint64(batch))
                place[at] = gram
            shard = (place % np.uint64(shards)).astype(np.int32)
            del place, gram, at
            by_shard = np.argsort(shard, kind="stable").astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])
            del shard
            got = [(batch, -1 - part, pack(n, np.array(held, np.uint8), np.array([i is None for i in ids], np.uint8), np.array([i or 0 for i in ids], np.int64)))]
            for s in range(shards):
                o = by_shard[ends[s] : ends[s + 1]]
                if len(o):
                    own, (u, i) = owner[o], np.unique(word[o + 1], return_inverse=True)
                    columns = [u, i.astype(np.int32), np.diff(own, prepend=0), np.array(held, np.uint8)]
                    for before in befores(word, o, order):
                        c = context(before)
                        columns += [c.astype(np.uint32), (c >> np.uint64(32)).astype(np.uint8)]
                    got.append((batch, s, pack(*columns)))
            ids.clear(), held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), (pa.int64(), pa.int32(), pa.binary()))], names=["batch", "shard", "data"])

        for rows in batches:
            for i, text, h in zip(*(rows.column(k).to_pylist() for k in range(3))):
                t = tokens(text)
                ids.append(i), held.append(bool(h)), texts.append(t)
                size += len(t)
                if size >= BATCH_TOKENS or len(ids) >= 1 << 20:
                    yield flush()
                    number, size = number + 1, 0
        if ids:
            yield flush()

    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held).mapInArrow(deal, "batch long, shard int, data binary")


SUMS = "batch long, docs boolean, data binary"


def sums(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 3, (pa.int64(), pa.bool_(), pa.binary()))], names=["batch", "docs", "data"])


def scores(train: int, known: int, hot: Hot):
    """A function from a shard's rows to what it knows of the sums of documents, by batch. Rows of documents pass through."""
    total = float(train + known + 1)

    def score(shard: pa.Table) -> pa.Table:
        rows = sorted(zip(shard.column("batch").to_pylist(), shard.column("data").to_pylist()))
        if shard.column("shard")[0].as_py() < 0:
            return sums([(b, True, d) for b, d in rows])
        parts = [unpack(d) for _, d in rows]
        word = np.concatenate([u[i] for u, i, *_ in parts])
        own = [np.cumsum(p[2], dtype=np.int64) for p in parts]
        train_at = np.concatenate([p[3][o] == 0 for p, o in zip(parts, own)])
        owner = np.concatenate([k << 20 | o for k, o in enumerate(own)])  # ascending
        before = [np.concatenate([p[k].astype(np.uint64) | p[k + 1].astype(np.uint64) << np.uint64(32) for p in parts]) for k in range(4, len(parts[0]), 2)]
        del parts, own
        # the sequences of each length, ascending: what they end in (of the length below), the word before, training counts
        words, node = np.unique(word, return_inverse=True)
        counts = np.bincount(node[train_at], minlength=len(words))
        same = hot.counts(0, words)
        counts, gram, levels = np.where(same >= 0, same, counts), words, []
        for d, b in enumerate(before, 1):
            key, node = np.unique(node.astype(np.uint64) << np.uint64(40) | b, return_inverse=True)
            above, b = (key >> np.uint64(40)).astype(np.int64), key & np.uint64((1 << 40) - 1)
            n = np.bincount(node[train_at], minlength=len(key))
            gram = longer(gram[above], b)
            same = hot.counts(d, gram)
            levels.append((above, b, np.where(same >= 0, same, n)))
        del word, before
        # of each level, what was seen in training goes to the trie
        stay, known_levels = counts > 0, []
        for above, b, n in levels:
            seen = n > 0
            known_levels.append((np.bincount(above[seen], minlength=len(stay))[stay], b[seen], n[seen]))
            stay = seen
        trie = Trie(words[counts > 0], counts[counts > 0], *known_levels[0], 1.0, total, known_levels[1:])
        found = trie.find(words)
        c = np.where(found >= 0, trie.counts[np.maximum(found, 0)], 0) if trie.words.n else np.zeros(len(words), np.int64)
        # each full sequence is looked up once: its word, and the words before it
        at, asked = np.arange(len(levels[-1][0])), []
        for above, b, _ in reversed(levels):
            asked.insert(0, b[at])
            at = above[at]
        loss = -sum(trie.grams(found[at], *asked))
        loss = np.round(loss * STEPS).astype(np.int64)  # not negative: a count is at most that of what it ends in
        base, is_known = np.round(np.log10(c + 1.0) * BASE_STEPS).astype(np.int64)[at], (found >= 0)[at]
        new = np.flatnonzero(np.diff(owner, prepend=-1))
        got = [np.add.reduceat(x[node], new) for x in (base, loss, is_known.astype(np.int32))]
        docs = owner[new]
        ends = np.searchsorted(docs >> 20, np.arange(len(rows) + 1))
        return sums([(b, False, pack((docs[i:j] & 0xFFFFF).astype(np.int32), *(x[i:j] for x in got))) for (b, _), i, j in zip(rows, ends[:-1], ends[1:]) if j > i])

    return score


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def gather(train: int, known: int):
    constant = float(np.log10(train + known + 1))

    def add(rows: pa.Table) -> pa.Table:
        docs = next(d for d, k in zip(rows.column("data").to_pylist(), rows.column("docs").to_pylist()) if k)
        n, held, null, ids = unpack(docs)
        base, loss, is_known = (np.zeros(len(n), np.int64) for _ in range(3))
        for data, k in sorted(zip(rows.column("data").to_pylist(), rows.column("docs").to_pylist())):
            if not k:
                at, b, x, c = unpack(data)
                base[at] += b
                loss[at] += x
                is_known[at] += c
        columns = [pa.array(ids, mask=null > 0), pa.array(held > 0), pa.array(n), pa.array(is_known), pa.array(np.full(len(n), train)), pa.array(base / BASE_STEPS - n * constant), pa.array(-loss / STEPS)]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return add


def lm_scores(docs: DataFrame, shard_tokens: int = SHARD_TOKENS, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text)."""
    words = vocabulary(docs)
    seen = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    train, known = seen[0] or 0, seen[1]
    hot = hot_sequences(docs, words, order, shard_tokens)
    shards = max(-(-train * FOLDS // ((FOLDS - 1) * shard_tokens)), 1)
    rows = route(docs, shards, hot, order).groupBy("shard").applyInArrow(scores(train, known, hot), SUMS)
    return rows.groupBy("batch").applyInArrow(gather(train, known), RESULT)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
