"""Document quality: kernel ridge regression on text statistics by random Fourier features, calibrated to a probability.

Statistics of a text (lengths, repetition, character classes, lines) are standardised and mapped by random cosines, whose inner
products approximate a Gaussian kernel. Every partition sums its part of the normal equations; the sums give the ridge weights. An
isotonic fit on labelled rows kept out of the equations turns ridge scores into probabilities.

Fitting uses at most about ``FIT_ROWS`` labelled rows; scoring covers every row and every whole text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clearway.llm.common import cut, id_and_text, labelled_sample

FIT_ROWS = 20_000
# Parts of the sample that sum normal equations on their own.
FIT_PARTS = 8
COSINES = 256
RIDGE = 1e-3
SEED = 20240229
# Ridge scores are counted in this many equal bins between these ends for calibration.
BINS, LOW, HIGH = 400, -0.5, 1.5

_UPPER, _LOWER, _DIGIT, _SPACE, _STOPS, _SYMBOLS, _HIGH = range(7)


def _classes() -> np.ndarray:
    table = np.zeros((256, 7))
    for b in range(256):
        c = chr(b)
        kind = (_HIGH if b >= 128 else _UPPER if c.isupper() else _LOWER if c.islower() else _DIGIT if c.isdigit()
                else _SPACE if c.isspace() or b < 32 else _STOPS if c in ".,;:'\"-()?" else _SYMBOLS)
        table[b, kind] = 1
    return table


STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_spread", "distinct_words", "commonest_word", "repeated_in_a_row",
    "upper", "lower", "digits", "space", "stops", "symbols", "beyond_ascii", "byte_entropy", "wordless", "odd_ends", "commonest_pair",
    "log_lines", "line_length", "repeated_lines", "capital_words",
)


def statistics(text: str) -> list[float]:
    """The values of ``STATISTICS``; all but the logarithms are shares or means, so they compare across lengths. Empty: zeros."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data):
        return [0.0] * len(STATISTICS)
    counts = np.bincount(data, minlength=256)
    share = counts @ _classes_table() / len(data)
    p = counts[counts > 0] / len(data)
    words = text.split() or [""]
    n = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    often = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    ends = Counter(w[-1:] for w in often)
    odd = sum(k for c, k in ends.items() if c and not c.isalnum() and c not in ".,;:?\"')")
    return [
        math.log1p(len(text)), math.log1p(n), min(50.0, lengths.mean()), min(50.0, lengths.std()), len(often) / n,
        max(often.values()) / n, sum(map(eq, words, words[1:])) / n,
        *share.tolist(), float(-(p * np.log2(p)).sum()),
        sum(k for w, k in often.items() if not any(map(str.isalnum, w))) / n, odd / len(often),
        max(pairs.values(), default=0) / max(1, n - 1),
        math.log1p(len(lines)), math.log1p(len(text) / len(lines)), 1 - len(set(lines)) / len(lines),
        sum(k for w, k in often.items() if len(w) > 1 and w.isupper()) / n,
    ]


_TABLE: list[np.ndarray] = []


def _classes_table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_classes())
    return _TABLE[0]


@dataclass(frozen=True)
class Model:
    """Everything a worker needs to score: scales, cosines, ridge weights and the calibration curve."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    curve_x: np.ndarray
    curve_y: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        return _features(stats, self.mean, self.scale, self.directions, self.phases)

    def ridge_scores(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.ridge_scores(stats), self.curve_x, self.curve_y)


def _features(stats, mean, scale, directions, phases) -> np.ndarray:
    z = np.clip((stats - mean) / scale, -6, 6)
    cosines = math.sqrt(2 / len(phases)) * np.cos(z @ directions + phases)
    return np.hstack([cosines, np.ones((len(z), 1))])


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            stats = pa.array([statistics(t) for t in part["text"].to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part["id"], part["label"], stats], names=["id", "label", "stats"])


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence with the least weighted squared distance to ``values``."""
    blocks: list[list[float]] = []  # mean, weight, number
    for v, w in zip(values.tolist(), weights.tolist()):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def _constant(rate: float) -> Model:
    d = len(STATISTICS)
    return Model(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(2), np.array([0.0]), np.array([rate]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> Model:
    """Fit on about ``rows`` labelled documents. Without labels every score is 0.5; with one class only, that class."""
    sample = cut(
        labelled_sample(docs, labels, label, rows, id_col, text_col)
        .mapInArrow(_statistics_of, "id long, label int, stats array<double>")
        # Every fourth row calibrates; copies of a text under other ids may be on both sides.
        .withColumn("calibrates", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(4)) == 0)
    ).coalesce(FIT_PARTS)  # of the written sample; the scan of all documents keeps its tasks
    n, rate = sample.agg(F.count("*"), F.avg("label")).first()
    if not n or rate in (0.0, 1.0):
        return _constant(0.5 if not n else rate)

    # One row per statistic.
    moments = {r.pos: r for r in sample.select(F.posexplode("stats")).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).collect()}
    d = len(STATISTICS)
    mean = np.array([moments[k].m for k in range(d)])
    # A constant statistic may come out a rounding error off zero.
    scale = np.array([moments[k].s if moments[k].s > 1e-9 else 1.0 for k in range(d)])
    rng = np.random.default_rng(SEED)
    directions = rng.normal(size=(d, COSINES)) / math.sqrt(d)
    phases = rng.uniform(0, 2 * math.pi, COSINES)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((COSINES + 1, COSINES + 2))
        for batch in batches:
            if batch.num_rows:
                x = _features(np.array(batch["stats"].to_pylist()), mean, scale, directions, phases)
                total += x.T @ np.hstack([x, batch["label"].to_numpy().astype(float)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(COSINES + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["line", "sums"])

    def added(key: tuple, lines: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"line": [key[0]], "sums": [np.sum(np.stack(lines["sums"]), axis=0)]})

    # Each partition sends its sums, as many numbers as there are coefficients, however many rows it read.
    lines = (
        sample.where(~F.col("calibrates")).select("stats", "label").mapInArrow(equations, "line int, sums array<double>")
        .groupBy("line").applyInPandas(added, "line int, sums array<double>").collect()
    )
    system = np.zeros((COSINES + 1, COSINES + 2))
    for r in lines:
        system[r.line] = r.sums
    gram, target = system[:, :-1], system[:, -1]
    weights = np.linalg.solve(gram + RIDGE * max(1.0, gram[-1, -1]) / COSINES * np.eye(len(gram)), target)
    model = Model(mean, scale, directions, phases, weights, np.zeros(1), np.zeros(1))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = model.ridge_scores(np.array(batch["stats"].to_pylist()))
                bins = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bins), batch["label"]], names=["bin", "label"])

    # At most one row per bin.
    counted = (
        sample.where("calibrates").select("stats", "label").mapInArrow(binned, "bin int, label int")
        .groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("ones")).orderBy("bin").collect()
    )
    if not counted:
        return _with_curve(model, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    n_rows = np.array([r.n for r in counted], dtype=float)
    level = pool_adjacent(np.array([r.ones for r in counted]) / n_rows, n_rows)
    centre = LOW + (np.array([r.bin for r in counted]) + 0.5) * (HIGH - LOW) / BINS
    return _with_curve(model, centre, level)


def _with_curve(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    return Model(model.mean, model.scale, model.directions, model.phases, model.weights, x, np.clip(y, 0.0, 1.0))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, the probability of label 1, of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                stats = np.array([statistics(t) for t in part["text"].to_pylist()]).reshape(-1, len(STATISTICS))
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(model.scores(stats))], names=["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        stats = np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS))
        return pd.Series(model.scores(stats))

    return docs.where(scored(F.coalesce(F.col(text_col), F.lit(""))) >= threshold)
