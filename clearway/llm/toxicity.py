"""Toxicity of texts: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its hashed n-grams of lower-cased UTF-8, word boundaries included. Each n-gram's log-count ratio compares how many
toxic and other labelled texts hold it. The n-grams that tell the classes apart most surely are the features; a logistic
regression is fitted on them, each scaled by its ratio. Every partition of the sample sums its part of the counts and of the gradient.

Fitting uses at most about ``FIT_ROWS`` labelled rows; scoring covers every row and every whole text.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clearway.llm.common import cut, id_and_text, labelled_sample

FIT_ROWS = 20_000
# Parts of the sample that sum counts and gradients on their own.
FIT_PARTS = 8
GRAMS = (4, 5, 6)
BUCKETS = 1 << 20
FEATURES = 4096
# An n-gram needs this many texts; counts start at SMOOTHING.
LEAST_TEXTS = 3
SMOOTHING = 0.5
PENALTY = 1e-5
STEPS = 30
SLICE = 1 << 20


def gram_slices(text: str) -> Iterator[np.ndarray]:
    """The buckets of all n-grams, repeats included, in parts that bound the memory a long text needs."""
    data = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for at in range(0, len(data), SLICE):
        part = data[at: at + SLICE + max(GRAMS) - 1].astype(np.uint32)
        key = part
        for n in range(2, max(GRAMS) + 1):
            if len(part) < n:
                break
            key = key[:-1] * np.uint32(0x01000193) + part[n - 1:]
            if n in GRAMS:
                mixed = key ^ (key >> np.uint32(15))
                mixed *= np.uint32(0x9E3779B1)
                yield mixed[:SLICE] >> shift


def grams(text: str) -> np.ndarray:
    """The distinct buckets of a text."""
    parts = list(gram_slices(text))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)


@dataclass(frozen=True)
class Model:
    """The buckets that are features, in order, their weights (ratio times coefficient) and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def scorer(self) -> Callable[[str], float]:
        lookup = lookup_of(self.buckets)

        def score(text: str) -> float:
            z = self.intercept + float(self.weights[features_of(text, lookup)].sum())
            return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))

        return score


def lookup_of(buckets: np.ndarray) -> np.ndarray:
    """Bucket to feature number, -1 for none."""
    lookup = np.full(BUCKETS, -1, dtype=np.int16)
    lookup[buckets] = np.arange(len(buckets), dtype=np.int16)
    return lookup


def features_of(text: str, lookup: np.ndarray) -> np.ndarray:
    """The distinct features of a text."""
    hits = []
    for part in gram_slices(text):
        found = lookup[part]
        hits.append(found[found >= 0])
    return np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int16)


def _minimise(value_and_gradient: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int) -> np.ndarray:
    """Limited-memory quasi-Newton steps with halving; the function is convex."""
    x = start
    value, gradient = value_and_gradient(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    calls = 1
    while calls < steps and np.abs(gradient).max() > 1e-5:
        q, alphas = gradient.copy(), []
        for s, y in reversed(moves):
            alpha = s @ q / (s @ y)
            q -= alpha * y
            alphas.append(alpha)
        q *= moves[-1][0] @ moves[-1][1] / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1.0, np.linalg.norm(gradient))
        for (s, y), alpha in zip(moves, reversed(alphas)):
            q += (alpha - y @ q / (s @ y)) * s
        length = 1.0
        while True:
            candidate = x - length * q
            new_value, new_gradient = value_and_gradient(candidate)
            calls += 1
            if new_value <= value - 1e-4 * length * (gradient @ q) or calls >= steps:
                break
            length /= 2
        if new_value > value:
            break
        s, y = candidate - x, new_gradient - gradient
        if s @ y > 1e-12:
            moves = [*moves[-7:], (s, y)]
        x, value, gradient = candidate, new_value, new_gradient
    return x


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> Model:
    """Fit on about ``rows`` labelled documents. Without labels every score is 0.5; with one class only, that class."""
    # Of the written sample; the scan of all documents keeps its tasks.
    sample = cut(labelled_sample(docs, labels, label, rows, id_col, text_col).select("text", "label")).coalesce(FIT_PARTS)
    n, ones = sample.agg(F.count("*"), F.sum("label")).first()
    nothing = np.zeros(0, np.int64), np.zeros(0)
    if not n:
        return Model(*nothing, 0.0)
    if ones in (0, n):
        return Model(*nothing, 40.0 if ones else -40.0)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for text, one in zip(batch["text"].to_pylist(), batch["label"].to_pylist()):
                held[one, grams(text)] += 1
        some = np.flatnonzero(held.any(axis=0))
        for at in range(0, len(some), 100_000):
            part = some[at: at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(held[0, part]), pa.array(held[1, part])], names=["bucket", "zeros", "ones"])

    # A row per bucket and part of the sample at most.
    a = SMOOTHING
    with_one, with_zero = F.col("ones") + a, F.col("zeros") + a
    share = (F.col("ones") + F.col("zeros")) / n
    surely = F.abs(F.col("ones") / ones - F.col("zeros") / (n - ones)) / F.sqrt(share * (1 - share) + 1.0 / n)
    chosen = (
        sample.mapInArrow(counted, "bucket long, zeros long, ones long").groupBy("bucket").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
        .where(F.col("ones") + F.col("zeros") >= LEAST_TEXTS)
        .select("bucket", (F.ln(with_one / (ones + 2 * a)) - F.ln(with_zero / (n - ones + 2 * a))).alias("ratio"), surely.alias("surely"))
        .orderBy(F.desc("surely"), "bucket").limit(FEATURES).collect()
    )
    if not chosen:
        return Model(*nothing, math.log(ones / (n - ones)))
    buckets = np.array([r.bucket for r in chosen])
    ratios = np.array([r.ratio for r in chosen])
    lookup = lookup_of(buckets)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [features_of(t, lookup) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["label"], pa.array(found, pa.list_(pa.int16()))], names=["label", "features"])

    points = cut(sample.mapInArrow(featured, "label int, features array<short>"))

    def value_and_gradient(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights, intercept = x[:-1] * ratios, x[-1]

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gradient, loss = np.zeros(len(weights) + 1), 0.0
            for batch in batches:
                if not batch.num_rows:
                    continue
                lists = batch["features"]
                flat = lists.flatten().to_numpy()
                row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                z = intercept + np.bincount(row, weights[flat], minlength=batch.num_rows)
                y = batch["label"].to_numpy()
                loss += float((np.logaddexp(0, z) - y * z).sum())
                off = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
                gradient[:-1] += np.bincount(flat, off[row], minlength=len(weights))
                gradient[-1] += off.sum()
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([gradient], pa.list_(pa.float64()))], names=["loss", "gradient"])

        # One row per part of the sample.
        parts = points.mapInArrow(summed, "loss double, gradient array<double>").collect()
        gradient = np.sum([r.gradient for r in parts], axis=0)
        gradient[:-1] *= ratios
        coefficients = x[:-1]
        penalised = gradient / n
        penalised[:-1] += PENALTY * coefficients
        return sum(r.loss for r in parts) / n + PENALTY / 2 * float(coefficients @ coefficients), penalised

    start = np.zeros(len(ratios) + 1)
    start[-1] = math.log(ones / (n - ones))
    x = _minimise(value_and_gradient, start, STEPS)
    return Model(buckets, x[:-1] * ratios, float(x[-1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, the probability of label 1, of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = model.scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array([one(t) for t in part["text"].to_pylist()], pa.float64())], names=["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score stays below ``threshold``, with all their columns."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = model.scorer()
        for texts in batches:
            yield texts.map(one).astype(float)

    return docs.where(scored(F.coalesce(F.col(text_col), F.lit(""))) < threshold)
