"""Whitened embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred integer vectors.

The distinct integer vectors lie in blocks over many tasks. Each step multiplies the centred rows by a short vector (a long vector, spread over
the blocks) and the transposed rows by the long one. Both sides are reorthogonalised in full: the short vectors where they are, the
long ones against all earlier ones inside the blocks, with coefficients summed over all of them. The small bidiagonal matrix gives the
components and deviations. A long vector is never stored: it is the rows times a known short vector, so a block that is lost is just read again.

What reaches the driver at each step is a few numbers per dimension and step; there are at most as many steps as dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clearway.llm.common import cut

SCALE = 256
# Vectors multiplied at once; bounds the memory of a product.
BLOCK = 4096
# Entries of the vectors that one task multiplies, on average; there are as many tasks as the session has cores at least, if there are as many parts.
TASK_ENTRIES = 1 << 22
# Partial sums meet in this many tasks before the driver adds them up.
PARTIAL_SUMS = 16
# A component is found once its residual is below this share of the largest deviation. A deviation below the other share of it counts as none:
# its square is less than the rounding of the largest one's.
TOLERANCE = 1e-14
LEAST_DEVIATION = 1e-8


@dataclass(frozen=True)
class Components:
    """Mean (as sums and count), unit components as rows by falling deviation, deviations, trace of the covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    deviations: np.ndarray
    trace: float
    steps: int


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, x): floor(scale * entry) of rows whose vector has only finite entries, as many as most rows have (in a tie the more entries)."""
    v = F.col("v")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where((F.size(v) > 0) & finite)
    lengths = rows.groupBy(F.size(v).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    # Without rows there is no length to keep.
    return rows.where(F.size(v) == (lengths.length if lengths else 0)).select("id", F.transform(v, lambda c: F.floor(c * scale).cast("long")).alias("x"))


def fit(vectors: DataFrame, wanted: int = 4) -> Components | None:
    """Components of the distinct vectors of column ``x``; None without rows. Fewer than ``wanted`` if the vectors span less."""
    distinct = cut(vectors.select("x").distinct())
    places = distinct.select(F.posexplode("x").alias("d", "c")).groupBy("d").agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(28,0)")).alias("s"))
    rows = places.orderBy("d").collect()
    if not rows:
        return None
    n, sums = rows[0].n, [int(r.s) for r in rows]
    centre = Centre.of(n, sums)
    return bidiagonalise(in_few_tasks(distinct, n * len(sums)), centre, n, sums, wanted)


def in_few_tasks(points: DataFrame, entries: int) -> DataFrame:
    """Parts put together, as every pass over them starts all tasks again."""
    return points.coalesce(max(points.sparkSession.sparkContext.defaultParallelism, -(-entries // TASK_ENTRIES)))


@dataclass(frozen=True)
class Centre:
    """A mean as whole numbers and what is left of it, so that subtracting loses nothing to the size of the mean."""

    whole: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(n: int, sums: list[int]) -> Centre:
        whole = [(2 * s + n) // (2 * n) for s in sums]
        return Centre(np.array(whole, dtype=np.int64), np.array([(s - n * w) / n for s, w in zip(sums, whole)]))

    def entries(self, lists: pa.Array) -> np.ndarray:
        """The rows of a list column as a matrix."""
        return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), len(self.whole))

    def rows(self, lists: pa.Array) -> np.ndarray:
        """The centred rows of a list column."""
        return (self.entries(lists) - self.whole).astype(np.float64) - self.rest


def summed(points: DataFrame, centre: Centre, per_block, size: int) -> np.ndarray:
    """Sum over all blocks of ``per_block(centred rows)``, a vector of ``size`` numbers, in two rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                total += per_block(centre.rows(batch["x"].slice(at, BLOCK)))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["part"])

    parts = points.mapInArrow(run, "part array<double>")
    if points.rdd.getNumPartitions() > PARTIAL_SUMS * PARTIAL_SUMS:
        # One row per task of the scan would grow with the table; sums of sums do not.
        parts = parts.select(F.spark_partition_id().alias("p"), F.posexplode("part").alias("i", "v")).groupBy(
            F.pmod("p", F.lit(PARTIAL_SUMS)).alias("p"), "i").agg(F.sum("v").alias("v")).groupBy("p").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda r: r["v"]).alias("part")).select("part")
    return np.sum([r.part for r in parts.collect()], axis=0) if size else np.zeros(0)


def bidiagonalise(points: DataFrame, centre: Centre, n: int, sums: list[int], wanted: int) -> Components:
    d = len(sums)
    trace = float(summed(points, centre, lambda x: np.array([np.einsum("ij,ij->", x, x)]), 1)[0]) / n
    none = Components(n, sums, np.zeros((0, d)), np.zeros(0), trace, 0)
    if trace == 0:
        return none
    right = np.zeros((0, d))     # short vectors, as rows
    weights = np.zeros((0, d))   # long vector k is the centred rows times weights[k]
    images = np.zeros((0, d))    # transposed rows times long vector k
    alphas: list[float] = []
    betas: list[float] = []
    largest = np.sqrt(trace * n)
    # Any start that is no eigenvector will do; this one has no zeros and no pattern. One product takes it into the space of the rows.
    v = np.cos(np.arange(1, d + 1) * 1.2345678)
    v = summed(points, centre, lambda x, start=v: x.T @ (x @ start), d)
    v /= np.linalg.norm(v)
    left_vectors = small = right_vectors = None
    while len(alphas) < min(d, n):
        # X v, and how much of it lies along each earlier long vector.
        def along(x: np.ndarray) -> np.ndarray:
            return (x @ weights.T).T @ (x @ v)

        new = v - along_all(points, centre, along, len(weights)) @ weights

        # The long vector that is left, once more against the earlier ones, its length, and its product with the transposed rows.
        def back(x: np.ndarray) -> np.ndarray:
            u = x @ new
            return np.concatenate([(x @ weights.T).T @ u, x.T @ u, [u @ u]])

        got = summed(points, centre, back, len(weights) + d + 1)
        again, image, square = got[: len(weights)], got[len(weights): -1], got[-1]
        square -= again @ again
        if square <= (LEAST_DEVIATION * largest) ** 2:
            # The rows have nothing more along v. What they had of it along the long vector before is a last column.
            if betas and betas[-1] > 0:
                right = np.vstack([right, v])
                band = np.hstack([np.diag(alphas) + np.diag(betas[:-1], 1), betas[-1] * np.eye(len(alphas))[:, -1:]])
                left_vectors, small, right_vectors = np.linalg.svd(band, full_matrices=False)
            break
        alpha = float(np.sqrt(square))
        weights = np.vstack([weights, (new - again @ weights) / alpha])
        image = (image - again @ images) / alpha
        images = np.vstack([images, image])
        right = np.vstack([right, v])
        alphas.append(alpha)
        # Next short vector, twice against all earlier ones.
        rest = image - alpha * v
        for _ in range(2):
            rest -= right.T @ (right @ rest)
        beta = float(np.linalg.norm(rest))
        steps = len(alphas)
        band = np.diag(alphas) + np.diag(betas, 1)
        left_vectors, small, right_vectors = np.linalg.svd(band)
        largest = small[0]
        residuals = beta * np.abs(left_vectors[-1, :wanted])
        if steps >= wanted and residuals.max() <= TOLERANCE * largest:
            break
        if beta <= LEAST_DEVIATION * largest:
            # The space found so far is closed; another one may lie outside it.
            rest = outside(right)
            beta = 0.0
            if rest is None:
                break
            v = rest
        else:
            v = rest / beta
        betas.append(beta)
    if small is None:
        return none
    keep = [k for k in range(min(wanted, len(small))) if small[k] > LEAST_DEVIATION * small[0]]
    found = right_vectors[keep] @ right
    # Either sign is right; the entry of greatest size is positive.
    found *= np.sign(found[np.arange(len(found)), np.abs(found).argmax(axis=1)])[:, None]
    found /= np.linalg.norm(found, axis=1, keepdims=True)
    return Components(n, sums, found, small[keep] / np.sqrt(n), trace, len(alphas))


def along_all(points: DataFrame, centre: Centre, along, size: int) -> np.ndarray:
    return summed(points, centre, along, size) if size else np.zeros(0)


def outside(right: np.ndarray) -> np.ndarray | None:
    """A unit vector at right angles to all rows; None if they span everything."""
    d = right.shape[1]
    if len(right) >= d:
        return None
    best = np.argmin((right ** 2).sum(axis=0))
    v = np.zeros(d)
    v[best] = 1.0
    for _ in range(2):
        v -= right.T @ (right @ v)
    return v / np.linalg.norm(v)


def identity_error(distinct: DataFrame, centre: Centre, model: Components) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, over the vectors of the fit."""
    k = len(model.vectors)
    to_white = (model.vectors / model.deviations[:, None]).T

    def run(x: np.ndarray) -> np.ndarray:
        y = x @ to_white
        return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])

    got = summed(distinct, centre, run, k * k + k)
    mean = got[k * k:] / model.n
    return float(np.abs(got[: k * k].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0


def deviations_of(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - sum)^2 of each row, exact; None if it needs more than 64 bits."""
    most = n * float(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, sums))
    if len(sums) * most * most < 2.0 ** 62:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    exact = (sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist())
    return [e if e < 1 << 63 else None for e in exact]


def whiten(df: DataFrame, wanted: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable vector and component.

    Unusable rows are left out: null or empty vectors, entries that are null or not finite, and lengths other than the most frequent one.
    Repeated vectors count once in the fit and are all returned; so are rows with null ids. If the distinct vectors span fewer than ``wanted``
    dimensions there are fewer components, none for equal vectors and empty tables. ``deviation`` is null beyond 64 bits.
    """
    vectors = cut(integer_vectors(df, id_col, vector_col, scale))
    model = fit(vectors, wanted)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.vectors):
        return df.sparkSession.createDataFrame([], schema)
    centre = Centre.of(model.n, model.sums)
    error = identity_error(vectors.select("x").distinct(), centre, model)
    to_white = (model.vectors / model.deviations[:, None]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                exact = deviations_of(centre.entries(part["x"]), model.n, model.sums)
                white = centre.rows(part["x"]) @ to_white
                yield pa.RecordBatch.from_arrays(
                    [part["id"], pa.array(exact, pa.int64()), pa.array(list(white), pa.list_(pa.float64()))], names=["id", "deviation", "white"])

    white = vectors.mapInArrow(run, "id long, deviation long, white array<double>")
    explained = F.array(*(F.lit(float(s * s / model.trace)) for s in model.deviations))
    return white.select("id", "deviation", F.posexplode("white").alias("at", "whitened")).select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, "at").alias("explained"), F.lit(error).alias("identity_error"))
