"""Operator 10: quality by naive Bayes support vectors.

Features are indicators of n-grams, hashed to ``BUCKETS`` buckets: words, and runs of one to three word shapes (letters by
case, digits, other characters, and whether a word repeats the one before). Each indicator is scaled by its class
log-count ratio; a linear model with hinge loss is then fitted by dual coordinate descent until the gradients agree, classes weighted
alike, and its margin is calibrated on a fifth of the sample that the fit didn't see.

The sample is at most ``most`` labelled rows (those with the smallest hash of their id) outside the held-out fold, which
bounds what reaches the driver; every document is scored on its whole text.

Defined cases: null and empty texts have no feature and get the score of the bias; without both classes every score is
the smoothed base rate; an empty table gives no rows; repeated rows are scored each; held_out is null for a null doc_id; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Memo, arrow_map, documents, fold, logistic_fit, sigmoid
from tessera.llm.near_dedup import mix
from tessera.llm.toxicity import labelled

BUCKETS, MOST, FOLDS, HELD, CUT = 1 << 20, 10_000, 4, 2, 0.7
SMOOTH, COST, EPOCHS, GAP = 1.0, 1.0, 60, 0.05
_MUL = np.uint64(0x9E3779B97F4A7C15)
_RUNS = [(re.compile(r"[^\W\d_]+"), lambda m: "A" if m.group().isupper() else "Aa" if m.group()[0].isupper() else "a"), (re.compile(r"\d+"), lambda m: "9")]


def shape(word: str) -> str:
    for pattern, name in _RUNS:
        word = pattern.sub(name, word)
    return word


def codes(word: str) -> tuple[int, int]:
    """Hashes of the word without case and of its shape."""
    return xxhash.xxh3_64_intdigest(word.lower().encode()), xxhash.xxh3_64_intdigest(shape(word).encode(), seed=1)


def features(text: str | None, memo: dict) -> np.ndarray:
    """The sorted distinct feature buckets of a text."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int32)
    both = np.array([memo[w] for w in words], np.uint64)
    word, form = both[:, 0], both[:, 1].copy()
    form[1:][word[1:] == word[:-1]] += np.uint64(1)  # a repeated word has a shape of its own
    grams, acc = [mix(word)], np.zeros(len(form), np.uint64)
    for n in range(min(3, len(form))):
        acc = acc[: len(form) - n] * _MUL + form[n:]
        grams.append(mix(acc + np.uint64(n + 1)))
    return np.unique(np.concatenate(grams) % np.uint64(BUCKETS)).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum() / np.sqrt(max(len(x), 1))) + self.bias

    def score(self, x: np.ndarray) -> float:
        return float(sigmoid(self.slope * self.margin(x) + self.offset))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    p, q = np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)
    for x, label in zip(rows, y):
        (p if label > 0 else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int = BUCKETS, epochs: int = EPOCHS, gap: float = GAP) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and dual variables of the L2-regularised hinge-loss model (Hsieh et al. 2008); rows hold feature ids, values
    theirs. Passes end when no projected gradient of a pass is further than ``gap`` from the others, or after ``epochs``."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    norm = np.array([(v * v).sum() + 1.0 for v in values])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        most, least = -np.inf, np.inf
        for i in order.permutation(len(rows)):
            x, v = rows[i], values[i]
            g = y[i] * (w[x] @ v + bias) - 1
            projected = min(g, 0.0) if alpha[i] <= 0 else max(g, 0.0) if alpha[i] >= cost[i] else g
            most, least = max(most, projected), min(least, projected)
            if projected:
                new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
                step = (new - alpha[i]) * y[i]
                w[x] += step * v
                bias += step
                alpha[i] = new
        if most - least < gap:
            break
    return w, bias, alpha


def fit(sample: DataFrame) -> Model:
    """The model of labelled rows (text, label); their number is bounded by the caller."""

    def grams(batches):
        memo = Memo(codes)
        for batch in batches:
            x = [features(t, memo).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1)], names=["x", "label"])

    got = sample.select("text", "label").mapInArrow(grams, "x binary, label int").toPandas().sort_values(["label", "x"])  # at most MOST rows; sorted, so that the fit is the same each time
    rows = [np.frombuffer(x, np.int32) for x in got["x"]]
    y = got["label"].to_numpy() * 2 - 1
    if len(set(y)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, *logistic_fit(np.zeros(len(y)), y > 0))
    ratios = log_count_ratios(rows, y)
    values = [ratios[x] / np.sqrt(max(len(x), 1)) for x in rows]
    held = np.arange(len(rows)) % 5 == 4
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    use = np.flatnonzero(~held)
    share = np.where(y > 0, (y[use] > 0).mean(), (y[use] < 0).mean())
    w, bias, _ = dual_coordinate_descent([rows[i] for i in use], [values[i] for i in use], y[use], COST * 0.5 / share[use])
    model = Model((w * ratios).astype(np.float32), bias, 1.0, 0.0)
    see = np.flatnonzero(held) if held.any() else use
    model.slope, model.offset = logistic_fit([model.margin(rows[i]) for i in see], y[see] > 0)
    return model


def apply(model: Model, docs: DataFrame) -> DataFrame:
    """doc_id, score, predicted of every row (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def make():
        m, memo = shared.value, Memo(codes)

        def step(doc_id, text):
            score = [m.score(features(t, memo)) for t in text]
            return {"doc_id": pa.array(doc_id, pa.int64()), "score": pa.array(score, pa.float64()), "predicted": pa.array([int(x >= CUT) for x in score], pa.int32())}

        return step

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, score double, predicted int")


def op10_quality(spark: SparkSession, sf_dir: str, most: int = MOST) -> DataFrame:
    """``most``: the bound on labelled rows that the model is fitted on."""
    docs = documents(spark, sf_dir)
    model = fit(labelled(spark, docs, sf_dir, "quality", FOLDS, HELD, most, "quality-sample"))
    return apply(model, docs).withColumn("held_out", fold(F.col("doc_id"), FOLDS) == HELD)
