"""Operator 11: fill-in-middle transformation of texts at unit boundaries, as an Arrow-batched pandas UDF.

A text is cut into units (lines by default) by ``finditer`` of the regex library; only the units' end offsets are kept, in one
compact array. A digest of the document's id gives two cuts, the form (plain, psm or spm) and nothing else, so that a row's result
depends on that row alone: whatever the partitions, and however often a lost executor's task is run again. Two lookups in the array
give the offsets at which prefix, middle and suffix are sliced.

Sentinels must not be able to arise where a sentinel meets text; ``Recipe`` refuses those that could (an end of one that is a
beginning of one), so that ``restored`` finds the parts by the first occurrence of each.

Defined cases: a null text counts as empty; an empty text, and one that contains a sentinel, stays as it is (form plain); a null
doc_id draws by the empty id; repeated rows get equal results; an empty table gives no rows; extra columns are ignored. A text is held
whole in its task, some four times over; nothing else grows with it.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import product

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents

LINES = r"[^\n]*\n|[^\n]+"
PARTS = "n long, form string, prefix_chars long, middle_chars long, output string"
DIGESTS = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


@dataclass(frozen=True)
class Recipe:
    """How texts are cut and put together: the units' pattern, the seed, shares in per cent, and the sentinels of the three parts."""

    unit: str = LINES
    seed: int = 7
    percent: int = 100
    spm_percent: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = list(enumerate((self.prefix, self.suffix, self.middle)))
        meets = lambda a, b: any(a.endswith(b[:k]) for k in range(1, len(b)))
        if any(not a or meets(a, b) or (i != j and b in a) for (i, a), (j, b) in product(marks, marks)):
            raise ValueError("sentinels must not be empty or hold each other, and no end of one may begin one")

    @cached_property
    def pattern(self):
        return regex.compile(self.unit)

    def draws(self, doc_id: int | None) -> list[int]:
        """The four numbers that the document's id gives."""
        hexed = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return [int(hexed[k : k + 8], 16) for k in range(0, 32, 8)]

    def ends(self, text: str) -> array:
        """Where the units end, with 0 before them."""
        return array("q", [0, *(m.end() for m in self.pattern.finditer(text))])

    def transformed(self, doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
        """n, form, prefix_chars, middle_chars and output."""
        ends = self.ends(text)
        n = len(ends) - 1
        h1, h2, h3, h4 = self.draws(doc_id)
        if not text or h3 % 100 >= self.percent or any(mark in text for mark in (self.prefix, self.suffix, self.middle)):
            return n, "plain", None, None, text
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = ends[low], ends[high]
        before, after = self.prefix + text[:a], self.suffix + text[b:]
        form = "spm" if h4 % 100 < self.spm_percent else "psm"
        return n, form, a, b - a, (after + before if form == "spm" else before + after) + self.middle + text[a:b]

    def restored(self, output: str, form: str) -> str:
        """The text that gave the output."""
        if form == "plain":
            return output
        one, two = (self.suffix, self.prefix) if form == "spm" else (self.prefix, self.suffix)
        first, rest = output[len(one) :].split(two, 1)
        second, middle = rest.split(self.middle, 1)
        return second + middle + first if form == "spm" else first + middle + second


def hexed(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def _udf(step, schema: str):
    names = [field.split()[0] for field in schema.split(", ")]

    @F.pandas_udf(schema)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            rows = [step(None if pd.isna(i) else int(i), t) for i, t in zip(ids, texts)]
            out = pd.DataFrame(rows, columns=names, dtype=object)
            yield out.astype({c: "Int64" for c in names if c == "n" or c.endswith("_chars")})

    return run


def parts(recipe: Recipe):
    """A pandas UDF of (doc_id, text): n, form, prefix_chars, middle_chars, output."""
    return _udf(recipe.transformed, PARTS)


def digests(recipe: Recipe):
    """The same with digests of the output, and of the text put together again from output and form, in place of the output."""

    def step(doc_id, text):
        *rest, output = recipe.transformed(doc_id, text)
        return *rest, hexed(output), hexed(recipe.restored(output, rest[1]))

    return _udf(step, DIGESTS)


def back(recipe: Recipe):
    """A pandas UDF of (output, form): the text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for outputs, forms in batches:
            yield pd.Series([recipe.restored(o, f) for o, f in zip(outputs, forms)], dtype=object)

    return run


def mapped(docs: DataFrame, udf) -> DataFrame:
    text: Column = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", udf("doc_id", "text").alias("r")).select("doc_id", "r.*")


def fill_in_middle(docs: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row of ``docs`` (doc_id, text)."""
    return mapped(docs, parts(recipe))


def restore(rows: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """The rows of ``fill_in_middle`` as doc_id, text."""
    return rows.select("doc_id", back(recipe)("output", "form").alias("text"))


def fill_in_middle_digests(docs: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256: the outputs stay in the workers."""
    return mapped(docs, digests(recipe))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_digests(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS x FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, ('0x' || x[1:8])::UBIGINT AS h1, ('0x' || x[9:16])::UBIGINT AS h2, ('0x' || x[17:24])::UBIGINT AS h3, ('0x' || x[25:32])::UBIGINT AS h4 FROM d),
k AS (SELECT *, len(units) AS n, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 AS plain FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b FROM k),
p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN length(pre) END AS prefix_chars, CASE WHEN NOT plain THEN length(mid) END AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN h4 % 100 < 50 THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
