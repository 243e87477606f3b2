"""Greedy choices in an order: two-key dedup and keep-first among near rows; ranges split at points."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


def first_of_two_keys(df: DataFrame, key: str, order: str, one: str, two: str) -> DataFrame:
    """key, order, one, two of the rows that stay: in order, a row goes if its first or its second key was kept before; rows that go
    register neither. Exact repeats of (one, two) can't stay twice, so that only distinct pairs are gathered for a key."""
    pairs = df.groupBy(key, one, two).agg(F.min(order).alias(order))
    lists = pairs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, one, two))).alias("_rows"))
    start = F.filter(F.slice("_rows", 1, 1), lambda r: F.lit(False))
    seen = lambda kept, r: F.exists(kept, lambda k: (k[one] == r[one]) | (k[two] == r[two]))
    kept = F.aggregate("_rows", start, lambda kept, r: F.when(seen(kept, r), kept).otherwise(F.array_append(kept, r)))
    return lists.select(key, F.explode(kept).alias("r")).select(key, f"r.{order}", f"r.{one}", f"r.{two}")


def _settled(batches):
    """Of pairs by (right_id, left_id), the rows (right_id) whose fate their own task knows: id, kept."""
    fates, kind, last, found = {}, None, None, []
    name = lambda x: tuple(x.values()) if isinstance(x, dict) else x

    def close(seen):
        if seen["kept"] or not seen["open"]:
            fates[name(seen["id"])] = not seen["kept"]
            found.append((seen["id"], not seen["kept"]))

    for batch in batches:
        kind = kind or batch.schema.field("right_id").type
        for left, right, known in zip(*(batch.column(c).to_pylist() for c in ("left_id", "right_id", "left_kept"))):
            if last is None or last["id"] != right:
                if last:
                    close(last)
                last = {"id": right, "kept": False, "open": False}
            fate = fates.get(name(left)) if known is None else known
            last["kept"] |= fate is True
            last["open"] |= fate is None
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], kind), pa.array([k for _, k in found], pa.bool_())], names=["id", "kept"])
        found.clear()
    if last:
        close(last)
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], kind), pa.array([k for _, k in found], pa.bool_())], names=["id", "kept"])


def keep_first_of_near(nodes: DataFrame, pairs: DataFrame, cut) -> DataFrame:
    """id, kept: in order of id, a row is kept if no kept row before it is near. ``pairs``: (left_id, right_id), left_id < right_id.

    Not transitive: a row near one that went may stay. Pairs are dealt by ranges of the later id and settled within a task in order; a
    round decides at least all of the first open range, so that there are at most as many rounds as partitions (a chain of any length
    in one range is one round), and mostly one or two. ``cut`` writes a frame and reads it back, which ends its lineage.
    """
    later = cut(pairs.select(F.col("right_id").alias("left_id")).distinct())
    first = pairs.join(later, "left_id", "left_anti").select("left_id", "right_id", F.lit(True).alias("left_kept"))  # nothing is before these
    rest = pairs.join(later, "left_id", "left_semi").select("left_id", "right_id", F.lit(None).cast("boolean").alias("left_kept"))
    open_, gone = cut(first.unionByName(rest)), None
    schema = StructType([StructField("id", pairs.schema["right_id"].dataType), StructField("kept", BooleanType())])
    while not open_.isEmpty():
        found = cut(open_.repartitionByRange("right_id").sortWithinPartitions("right_id", "left_id").mapInArrow(_settled, schema))
        out = found.where("NOT kept").select("id")
        gone = out if gone is None else gone.unionByName(out)
        left = open_.join(found.select(F.col("id").alias("right_id")), "right_id", "left_anti").join(found.withColumnRenamed("id", "left_id"), "left_id", "left")
        open_ = cut(left.select("left_id", "right_id", F.coalesce("left_kept", "kept").alias("left_kept")))
    if gone is None:
        return nodes.select("id", F.lit(True).alias("kept"))
    return nodes.select("id").join(gone.withColumn("_gone", F.lit(True)), "id", "left").select("id", F.col("_gone").isNull().alias("kept"))


def split_at(start: Column, end: Column, points: Column, edge: float) -> Column:
    """The range in pieces at ascending points inside, but for points within ``edge`` of its ends and pieces shorter than ``edge``."""
    inside = F.concat(F.array(start), F.filter(points, lambda t: (t > start + edge) & (t < end - edge)), F.array(end))
    pieces = F.transform(F.sequence(F.lit(0), F.size(inside) - 2), lambda i: F.struct(inside[i].alias("start"), inside[i + 1].alias("end")))
    long = F.filter(pieces, lambda r: r["end"] - r["start"] >= edge)
    whole = F.array(F.struct(start.alias("start"), end.alias("end")))
    return F.when((end - start < 2 * edge) | (F.size(long) == 0), whole).otherwise(long)
