"""Terms of one table in the texts of another, by Aho-Corasick automata: each text is read once, whatever the number of terms."""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of terms that one automaton, and one broadcast, holds.
MOST_BYTES = 16 << 20


def found(texts: DataFrame, text: str, terms: DataFrame, term: str, cut: Callable[[DataFrame], DataFrame], most_bytes: int = MOST_BYTES) -> DataFrame:
    """text, term of the different texts and the different terms that they hold, a row each; null and the empty term are in none.

    Terms beyond ``most_bytes`` are dealt over several automata, one after the other, by their hash; texts are read once for each.
    """
    known = cut(terms.select(F.col(term).cast("string").alias("term")).where("term <> ''").distinct())
    size = known.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    parts, out = max(-(-size * 2 // most_bytes), 1) if size > most_bytes else 1, None  # twice as many, since hashes don't deal evenly
    rows = texts.select(F.col(text).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    for k in range(parts):
        some = known if parts == 1 else known.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k)
        held = texts.sparkSession.sparkContext.broadcast([r["term"] for r in some.toLocalIterator()])

        def search(batches, held=held):
            automaton = ahocorasick.Automaton()
            for t in held.value:
                automaton.add_word(t, t)
            automaton.make_automaton()
            for batch in batches:
                pairs = [(x, t) for x in batch.column(0).to_pylist() for t in sorted({t for _, t in automaton.iter(x)})] if held.value else []
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.string()), pa.array([t for _, t in pairs], pa.string())], names=["text", "term"])

        part = rows.mapInArrow(search, "text string, term string")
        out = part if out is None else out.unionByName(part)
    return out


def overlapping(left: DataFrame, right: DataFrame, tag: str, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """left_tag, right_tag of the different tags of both sides of which one is, or is in, the other."""
    one = found(left, tag, right, tag, cut).select(F.col("text").alias("left_tag"), F.col("term").alias("right_tag"))
    two = found(right, tag, left, tag, cut).select(F.col("term").alias("left_tag"), F.col("text").alias("right_tag"))
    return one.unionByName(two).distinct()
