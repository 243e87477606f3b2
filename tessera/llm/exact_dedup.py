"""Operator 2: exact deduplication by keyed streaming state. DataFrame and SQL functions only.

Every row becomes a line of a *digest log* (digest, id, locator), which is what the stream reads. A stateful streaming
aggregation keyed by the digest, in a disk-backed state store and without expiry, retains per digest the smallest id seen
(the stable identifier), its content locator (file and row index) and the number of rows. Rows that hit a digest held
by another row are then checked on their full bytes against the retained row's content; should two contents share a
digest, rows of such a digest are grouped by content instead.

Hot digests: rows are combined before the shuffle, and the check of bytes salts a digest's rows over as many copies of
the retained content as the group's size asks for. Nothing is dropped or capped. State is resumable: with the same
``state`` folder a later call adds its rows to what is known.

Defined cases: a null text counts as empty; empty texts are equal to each other; white space runs count as one space;
a repeated doc_id is a row like any other (each of the rows is returned); a null doc_id comes after all others, so that such a
row is retained only where no row of its group has an id (keep_id is null there); an empty table gives no rows; extra columns,
also such named like the results, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, documents, perhaps_in, scratch, written

#: Rows of one digest that are checked against one copy of the retained content.
ROWS_A_SALT = 2_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def first_row(id_: str) -> Column:
    """The row with the smallest id as a struct; rows without an id come last."""
    return F.min(F.struct(F.col(id_).isNull().alias("no_id"), id_, "locator"))


def fold_stream(log: DataFrame, spark: SparkSession, state: str, out: str) -> None:
    """Runs the stream over all of ``log`` that is new to ``state``; each micro-batch writes the digests it changed to ``out``."""
    groups = log.groupBy("digest").agg(first_row("doc_id").alias("first"), F.count(F.lit(1)).alias("group_size"))

    def sink(rows: DataFrame, batch: int) -> None:
        rows.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.locator").alias("locator"), "group_size").write.mode(
            "overwrite"
        ).parquet(f"{out}/batch={batch}")

    query = (
        groups.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def digest_groups(log_path: str, spark: SparkSession, schema, state: str | None = None, files_a_batch: int | None = None) -> DataFrame:
    """digest, keep_id, locator, group_size of a digest log, by the streaming state."""
    own = spark.newSession()  # the state store's settings stay out of the caller's session
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # many small stores: no preallocation
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    reader = own.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    out = scratch(spark, "dedup-groups")
    fold_stream(reader.parquet(log_path), own, state or scratch(spark, "dedup-state"), out)
    try:
        changes = spark.read.parquet(out)
    except Exception as error:  # no micro-batch ran: the log holds no file with rows
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return spark.createDataFrame([], "digest string, keep_id long, locator string, group_size long")
    # counts only rise and identifiers only fall, so the last change of a digest is the extreme one
    return changes.groupBy("digest").agg(first_row("keep_id").alias("k"), F.max("group_size").alias("group_size")).select("digest", "k.keep_id", "k.locator", "group_size")


def with_locator(docs: DataFrame, scanned: bool = False) -> tuple[DataFrame, str]:
    """``docs`` with the place of each row, and the name of the column with it (one that ``docs`` hasn't).

    ``scanned``: the rows are those of files, one each, so that the place in the file tells them apart. Others (which may
    have been multiplied or joined since they were read) are written to the shared folder with a number.
    """
    taken, name = {c.lower() for c in docs.columns}, "locator"
    while name in taken:
        name = f"_{name}"
    if scanned:
        return docs.select("*", F.concat_ws("#", "_metadata.file_path", "_metadata.row_index").alias(name)), name
    return written(docs.withColumn(name, F.monotonically_increasing_id().cast("string")), "dedup-rows"), name


def stays(docs: DataFrame, judge) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns; it gets rows (doc_id, text, locator)."""
    located, place = with_locator(docs)
    at = F.col(place).alias("locator")
    kept = judge(located.select(F.col("doc_id").cast("long").alias("doc_id"), "text", at)).where("kept").select(F.col("locator").alias(place))
    return located.join(kept, place, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_dedup(docs: DataFrame, digest_of=digest, rows_a_salt: int = ROWS_A_SALT, files_a_batch: int | None = None, scanned: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text). ``scanned``: see with_locator."""
    located, place = with_locator(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scanned)
    return dedup_located(located.withColumnRenamed(place, "locator"), digest_of, rows_a_salt, files_a_batch).drop("locator")


def dedup_located(docs: DataFrame, digest_of=digest, rows_a_salt: int = ROWS_A_SALT, files_a_batch: int | None = None) -> DataFrame:
    """The result of exact_dedup and the rows' locators, for rows (doc_id, text, locator).

    ``digest_of`` is a parameter only so that tests can force two contents to share a digest.
    """
    spark = docs.sparkSession
    norm = normalised(F.col("text"))
    lines = docs.select("doc_id", digest_of(norm).alias("digest"), digest(norm).alias("text_sha256"), "locator")
    log_path = scratch(spark, "dedup-log")
    lines.write.parquet(log_path)
    log = spark.read.schema(lines.schema).parquet(log_path)
    groups = digest_groups(log_path, spark, log.schema, files_a_batch=files_a_batch)
    groups = written(groups, "dedup-state-rows")

    located = log.join(groups.select("digest", "keep_id", F.col("locator").alias("keep_locator"), "group_size"), "digest")
    hits = located.where("group_size > 1")
    # full bytes of the hits: the narrow hit rows meet the text again by locator, then the retained content by digest;
    # texts without a hit stay where they lie
    number = groups.where("group_size > 1").agg(F.sum("group_size")).first()[0] or 0
    texts = perhaps_in(docs.select("locator", "text"), hits, "locator", number).select("locator", norm.alias("norm"))
    hit_texts = hits.select("locator", "digest", "keep_locator", "group_size").join(texts, "locator")
    copies = F.ceil(F.col("group_size") / F.lit(rows_a_salt)).cast("int")
    salted = hit_texts.withColumn("salt", F.pmod(F.xxhash64("locator"), copies).cast("int"))
    retained = hit_texts.where("locator = keep_locator").select(
        "digest", F.col("norm").alias("held"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt")
    )
    differing = written(
        salted.join(retained, ["digest", "salt"]).where("norm <> held").select("digest").distinct(), "dedup-collisions"
    )
    plain = located.select(
        "doc_id", "keep_id", "group_size", (F.col("locator") == F.col("keep_locator")).alias("kept"), "text_sha256", "digest", "locator"
    )
    if differing.isEmpty():
        return plain.drop("digest")
    # contents that share a digest: these few digests are grouped by content
    by_text = hit_texts.join(differing, "digest", "left_semi").join(log.select("locator", "doc_id", "text_sha256"), "locator")
    firsts = by_text.groupBy("digest", "norm").agg(first_row("doc_id").alias("k"), F.count(F.lit(1)).alias("group_size"))
    apart = by_text.drop("group_size").join(firsts, ["digest", "norm"]).select(
        "doc_id", F.col("k.doc_id").alias("keep_id"), "group_size", (F.col("locator") == F.col("k.locator")).alias("kept"), "text_sha256", "locator"
    )
    return plain.join(differing, "digest", "left_anti").drop("digest").unionByName(apart)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), scanned=True)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that stay, with their columns."""
    return stays(docs, dedup_located)


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
