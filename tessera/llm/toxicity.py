"""Operator 4: toxic passages by maximum-scoring segments over token log-odds.

Features are words and their first 4 to 8 letters, so that inflected and compound forms count together. A feature's score
is its log-odds between toxic and other labelled text under an informative Dirichlet prior, taken at the lower end of its
confidence interval, so that rare ones earn nothing by chance; a text that repeats a feature counts it ``BURST`` times at most there,
since repeats within a text are no independent draws; a token scores as its best feature. A linear scan (all maximal scoring
subsequences, after Ruzzo and Tompa) finds every passage. A passage of score S in a text of n tokens is expected
K*n*exp(-lambda*S) times by chance (Karlin and Altschul); passages under ``SIGNIFICANT`` count, and the sum of their
-ln E, on a log scale, is calibrated to a probability by a logistic fit.

Tokens are hashed to ``BUCKETS`` buckets, which bounds the model. The model is fitted on at most ``most`` labelled rows
(those with the smallest hash of their id) outside the held-out fold; every document is scored on its whole text.

Defined cases: null and empty texts have no passage and get the score of a text without any; without usable labels every
score is the smoothed base rate; an empty table gives no rows; repeated rows are scored each; held_out is null for a null doc_id; extra
columns are ignored by the query and kept by the stage.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Memo, arrow_map, documents, fold, logistic_fit, sampled_labels, sigmoid, sliced, written

BUCKETS, MOST, FOLDS, HELD = 1 << 18, 20_000, 3, 1
PRIOR, WIDTH, FLOOR, SIGNIFICANT, CUT = 2_000.0, 1.96, -0.5, 0.05, 0.7
#: How often one text's repeats of a feature count in what is learned; texts are read and scored whole.
BURST = 3
PREFIXES = range(4, 9)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def buckets_of(word: str) -> tuple[int, ...]:
    """The buckets of a word without case and outer punctuation, and of its beginnings; of nothing but punctuation, none."""
    core = _EDGE.sub("", word).lower()
    if not core:
        return ()
    return tuple(xxhash.xxh3_64_intdigest(x.encode()) % BUCKETS for x in (core, *(f"{core[:n]}*" for n in PREFIXES if n < len(core))))


def token_counts(rows: DataFrame) -> DataFrame:
    """bucket, toxic, other: feature counts of labelled rows (text, label), combined in each task before the shuffle."""

    def count(batches):
        buckets, total = Memo(buckets_of), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([b for w in (text or "").split() for b in buckets[w]], np.int64)
                own, times = np.unique(ids, return_counts=True)
                total[label, own] += np.minimum(times, BURST)
        seen = np.flatnonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[1, seen]), pa.array(total[0, seen])], names=["bucket", "toxic", "other"])

    counts = rows.select("text", "label").mapInArrow(count, "bucket long, toxic long, other long")
    return counts.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def log_odds(toxic: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Lower confidence ends of the log-odds of every bucket, from ``FLOOR`` up."""
    seen = toxic + other
    prior = PRIOR * (seen + 0.5) / (seen.sum() + 0.5 * len(seen))
    a, b = toxic + prior, other + prior
    delta = np.log(a / (toxic.sum() + PRIOR - a)) - np.log(b / (other.sum() + PRIOR - b))
    return np.maximum(delta - WIDTH * np.sqrt(1 / a + 1 / b), FLOOR)


def karlin_lambda(scores: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of sum(p * exp(lambda * s)) = 1; 1 if no token scores above 0 or the mean isn't below 0."""
    p = weight / max(weight.sum(), 1)
    if not ((scores > 0) & (p > 0)).any() or (p * scores).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (p * np.exp(high * scores)).sum() < 1:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * scores)).sum() < 1 else (low, mid)
    return high


def segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time."""
    up = np.flatnonzero(s > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(s)])
    cuts = np.flatnonzero(np.diff(up) > 1)
    starts, ends = up[np.concatenate([[0], cuts + 1])], up[np.concatenate([cuts, [len(up) - 1]])] + 1
    kept: list[tuple[float, float, int, int, int]] = []  # sums before and after, start, end, last earlier one with a smaller sum before
    for start, end in zip(starts.tolist(), ends.tolist()):
        before, after = total[start], total[end]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= after:
                kept.append((before, after, start, end, j))
                break
            before, start = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, float(y - x)) for x, y, a, b, _ in kept]


def token_scores(table: np.ndarray) -> Memo:
    """The score of a token by its text: that of its best feature; punctuation alone scores nothing."""
    return Memo(lambda w: max((float(table[b]) for b in buckets_of(w)), default=0.0), 300_000)


@dataclass
class Model:
    table: np.ndarray
    lam: float
    k: float
    slope: float
    offset: float

    def passages(self, words: list[str], scores: Memo) -> list[tuple[int, int, float]]:
        """Significant passages of a text: first word, word after the last, logarithm of the number expected by chance."""
        found = ((a, b, np.log(self.k * len(words)) - self.lam * x) for a, b, x in segments(np.array([scores[w] for w in words])))
        return [x for x in found if x[2] < np.log(SIGNIFICANT)]

    def score(self, passages: list[tuple[int, int, float]]) -> float:
        return float(sigmoid(self.slope * np.log1p(-sum(e for _, _, e in passages)) + self.offset))


def fit(rows: DataFrame) -> Model:
    """The model of labelled rows (text, label); their number is bounded by the caller."""
    toxic, other = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in token_counts(rows).toLocalIterator():  # at most BUCKETS rows
        toxic[row[0]], other[row[0]] = row[1], row[2]
    table = log_odds(toxic, other)

    def chance(batches):
        scores = token_scores(table)
        for batch in batches:
            all_scores = [np.array([scores[w] for w in (t or "").split()]) for t in batch.column(0).to_pylist()]
            value, times = np.unique(np.round(np.concatenate([np.zeros(0), *all_scores]), 2), return_counts=True)
            tops = [(len(s), max((x for _, _, x in segments(s)), default=0.0)) for s in all_scores if len(s)]
            columns = [pa.array([*value, *[None] * len(tops)], pa.float64()), pa.array([*times, *(n for n, _ in tops)], pa.int64()), pa.array([*[None] * len(value), *(x for _, x in tops)], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["value", "n", "top"])

    seen = written(rows.where("label = 0").select("text").mapInArrow(chance, "value double, n long, top double"), "toxic-chance")
    scored = seen.where("value IS NOT NULL").groupBy("value").agg(F.sum("n").alias("n")).toPandas()  # scores by hundredths
    lam = karlin_lambda(scored["value"].to_numpy(float), scored["n"].to_numpy(float))
    mean = seen.where("top IS NOT NULL").agg(F.avg(F.col("n") * F.exp(-F.lit(lam) * F.col("top")))).first()[0]
    model = Model(table, lam, 1 / mean if mean else 1.0, 0.0, 0.0)  # K*n*exp(-lambda*S) is exponential with mean 1

    def evidence(batches):
        scores = token_scores(table)
        for batch in batches:
            out = [-sum(e for _, _, e in model.passages((t or "").split(), scores)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.log1p(out), pa.float64()), batch.column(1)], names=["x", "label"])

    points = rows.select("text", "label").mapInArrow(evidence, "x double, label int").toPandas()  # at most MOST rows
    model.slope, model.offset = logistic_fit(points["x"], points["label"])
    return model


def spans(text: str, passages: list[tuple[int, int, float]]) -> str:
    """start:end of the passages in code points, comma-joined."""
    if not passages:
        return ""
    at = [m.span() for m in re.finditer(r"\S+", text)]
    return ",".join(f"{at[a][0]}:{at[b - 1][1]}" for a, b, _ in passages)


def apply(model: Model, docs: DataFrame) -> DataFrame:
    """doc_id, score, predicted, n_passages, passages of every row (doc_id, text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS numbers

    def make():
        m = shared.value
        scores_of = token_scores(m.table)

        def step(doc_id, text):
            found = [m.passages((t or "").split(), scores_of) for t in text]
            score = [m.score(p) for p in found]
            return {
                "doc_id": pa.array(doc_id, pa.int64()),
                "score": pa.array(score, pa.float64()),
                "predicted": pa.array([int(x >= CUT) for x in score], pa.int32()),
                "n_passages": pa.array([len(p) for p in found], pa.int32()),
                "passages": pa.array([spans(t or "", p) for t, p in zip(text, found)], pa.string()),
            }

        return step

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, score double, predicted int, n_passages int, passages string")


def labelled(spark: SparkSession, docs: DataFrame, sf_dir: str, column: str, folds: int, held: int, most: int, name: str) -> DataFrame:
    """The labelled sample with its texts: at most ``most`` labels, so that they are broadcast and the texts stay in place."""
    sample = F.broadcast(sampled_labels(spark, sf_dir, column, folds, held, most))
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id").select("text", "label"), name)


def op4_toxicity(spark: SparkSession, sf_dir: str, most: int = MOST) -> DataFrame:
    """``most``: the bound on labelled rows that the model is fitted on."""
    docs = documents(spark, sf_dir)
    model = fit(labelled(spark, docs, sf_dir, "toxic", FOLDS, HELD, most, "toxic-sample"))
    return apply(model, docs).withColumn("held_out", fold(F.col("doc_id"), FOLDS) == HELD)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str, most: int = MOST) -> DataFrame:
    """Pipeline stage: the documents not found toxic, with their columns. Rows are filtered where they lie, without a shuffle."""
    model = fit(labelled(spark, docs, sf_dir, "toxic", FOLDS, HELD, most, "toxic-sample"))
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def clean(batches):
        m = shared.value
        scores_of = token_scores(m.table)
        for batch in chain.from_iterable(sliced(b) for b in batches):
            scores = [m.score(m.passages((t or "").split(), scores_of)) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([x < CUT for x in scores], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
