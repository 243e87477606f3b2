"""Operator 13: minimax contiguous partition of documents into shards.

Equal texts are one atomic group. Groups are ordered by their texts' digests, so that a row's shard follows from its digest and the
cuts: no row is joined with its group, and a group of any number of copies is placed by a comparison. The smallest capacity at which
the ordered groups fit into the shards is found by binary search, each capacity checked greedily, and the groups are cut there.

The groups aren't gathered for that. The driver holds a summary: bytes and number of groups by the first digits of the digest (4,096
stretches). A cut that falls inside a stretch is somewhere in it, which bounds the capacity from both sides; the stretches that cuts
may fall into (some tens for each shard) are then read with one more digit, until both bounds meet. The summary is thus bounded by the number of
shards, and takes a few rounds over a narrow table whatever the number of documents.

Groups that are alone as long as the mean shard of what is left (fewer than the shards) come first in the order and get shards of
their own, so that the others still share theirs evenly. ``bytes`` is near equal as far as whole groups allow.

Slots follow the order (shard, digest, doc_id), numbered by ranges of it: the same rows give the same slots in any partitions.

Defined cases: a null text has no bytes and is of one group with empty ones; a repeated doc_id or row is a row like any other;
a null doc_id comes first in its group; fewer groups than shards leave shards empty; an empty table gives no rows; extra columns are
ignored by ``sharded`` and kept by ``write_shards``.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, in_order, written

SHARDS, ROW_BYTES, DIGITS = 24, 8, 3


def digest(text: Column) -> Column:
    """What orders the groups: 128 bits of the text's SHA-256 in hex."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32)


class Summary:
    """Ordered groups as stretches: by first digits, the bytes and the number of the groups that begin with them."""

    def __init__(self, stretches: dict[str, tuple[int, int]]):
        self.names = sorted(stretches)
        self.whole = [stretches[n][1] == 1 for n in self.names]
        self.ends = list(accumulate(stretches[n][0] for n in self.names))

    def cut(self, at: int, hopeful: bool) -> tuple[int, int]:
        """Where the last group that ends by ``at`` ends, and the stretch after it: a group end for sure, or else the best that may be."""
        k = bisect_right(self.ends, at)
        start = self.ends[k - 1] if k else 0
        return (at if hopeful and k < len(self.ends) and not self.whole[k] else start), k

    def cuts(self, capacity: int, shards: int, hopeful: bool) -> list[tuple[int, int]]:
        """The greedy cuts, one a shard."""
        out, at = [], 0
        for _ in range(shards):
            at, k = self.cut(at + capacity, hopeful)
            out.append((at, k))
        return out

    def fits(self, capacity: int, shards: int, hopeful: bool) -> bool:
        return self.cuts(capacity, shards, hopeful)[-1][0] >= self.ends[-1]

    def smallest(self, low: int, high: int, shards: int, hopeful: bool) -> int:
        while low < high:
            middle = (low + high) // 2
            if self.fits(middle, shards, hopeful):
                high = middle
            else:
                low = middle + 1
        return low

    def open(self, low: int, high: int, shards: int) -> list[str]:
        """The stretches of several groups into which cuts of capacities from ``low`` to ``high`` may fall."""
        found = set()
        for (_, a), (_, b) in zip(self.cuts(low, shards, False), self.cuts(high, shards, True)):
            found.update(k for k in range(a, min(b + 1, len(self.names))) if not self.whole[k])
        return [self.names[k] for k in sorted(found)]


def stretches(groups: DataFrame, digits: int) -> dict[str, tuple[int, int]]:
    """Bytes and number of groups by their first digits; the caller bounds how many there are."""
    by = groups.groupBy(F.substring("digest", 1, digits).alias("name")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return {r["name"]: (r["bytes"], r["n"]) for r in by.collect()}


class Plan:
    """The shards of groups: those with one of their own by digest, and the digits at which the others are cut."""

    def __init__(self, alone: list[str], cuts: list[str], capacity: int):
        self.alone, self.cuts, self.capacity = alone, cuts, capacity

    def shard(self, of: Column) -> Column:
        """The shard of a digest."""
        after = F.lit(len(self.alone))
        if self.cuts:
            after = after + F.size(F.filter(F.array(*map(F.lit, self.cuts)), lambda c: c <= of))
        if not self.alone:
            return after.cast("int")
        own = F.array_position(F.array(*map(F.lit, self.alone)), of)
        return F.when(own > 0, own - 1).otherwise(after).cast("int")


def minimax(groups: DataFrame, shards: int = SHARDS, digits: int = DIGITS) -> Plan:
    """The plan for ``groups`` (digest, bytes), one row each, read a few times."""
    most = groups.orderBy(F.desc("bytes"), "digest").limit(shards).collect()  # a top list of ``shards`` rows
    left, alone = groups.agg(F.sum("bytes")).first()[0] or 0, []
    while len(alone) < min(shards - 1, len(most)) and most[len(alone)]["bytes"] * (shards - len(alone)) >= left:
        left -= most[len(alone)]["bytes"]
        alone.append(most[len(alone)]["digest"])
    shards -= len(alone)
    if not left:
        return Plan(alone, [], 0)
    rest = groups.where(~F.col("digest").isin(alone)) if alone else groups
    low, high = max(-(-left // shards), most[len(alone)]["bytes"] if len(alone) < len(most) else 0), left
    known = stretches(rest, digits)
    while True:
        summary = Summary(known)
        high = summary.smallest(low, high, shards, False)
        low = summary.smallest(low, high, shards, True)
        if low == high:
            break
        names = summary.open(low, high, shards)
        for n in sorted({len(x) for x in names}):
            some = [x for x in names if len(x) == n]
            known = {k: v for k, v in known.items() if k not in some} | stretches(rest.where(F.substring("digest", 1, n).isin(some)), n + 1)
    cuts = [summary.names[k] for _, k in summary.cuts(high, shards, False)[:-1] if k < len(summary.names)]
    return Plan(alone, cuts, high)


def sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), digest(F.col("text")).alias("digest")
    )


def grouped(rows: DataFrame) -> DataFrame:
    """digest and bytes of the groups; copies are summed before the shuffle."""
    return written(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "shard-groups")


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs`` (doc_id, text)."""
    rows = written(sized(docs), "shard-rows")
    plan = minimax(grouped(rows), shards)
    placed = in_order(rows.withColumn("shard", plan.shard(F.col("digest"))), ["shard", "digest", "doc_id"], "at")
    counts = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}  # a row a shard
    first = F.array(*(F.lit(sum(n for s, n in counts.items() if s < k)).cast("long") for k in range(shards)))
    law, none = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", (F.col("at") - F.element_at(first, F.col("shard") + 1)).alias("slot"), none)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> Plan:
    """Writes the rows with all their columns to one folder a shard (``shard=k``); a column of that name gets its folders as ``shard_``."""
    taken, name = {c.lower() for c in docs.columns}, "shard"
    while name in taken:
        name += "_"
    plan = minimax(grouped(sized(docs)), shards)
    docs.withColumn(name, plan.shard(digest(F.col("text")))).write.partitionBy(name).parquet(path)
    return plan


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir))
