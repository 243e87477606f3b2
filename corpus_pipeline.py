"""The corpus pipeline: documents through toxicity, exact and near deduplication, surrogates for personal data, and packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and is written as Parquet in the
shared folder and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import documents, written
from tessera.llm.exact_dedup import keep_first
from tessera.llm.near_dedup import keep_one
from tessera.llm.packing import pack_stage
from tessera.llm.pii import hide
from tessera.llm.toxicity import reject_toxic

STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", keep_first),
    ("near_dedup", keep_one),
    ("pii", hide),
    ("packing", pack_stage),
]
#: Learned scores, similarity and token ids can't be stated in SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
