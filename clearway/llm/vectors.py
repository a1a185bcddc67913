"""Near-duplicates among embeddings: spherical k-means cells, blocked cosine products inside cells, one row kept per group.

A vector belongs to the cell of its nearest centroid. A partner within the threshold may lie behind a border, so a vector also
visits every later cell whose border is within the threshold's angle of it; no link is lost, and each pair meets once. Where
vectors do not cluster, most borders are near and the comparison approaches all pairs: exactness costs that.

Equal vectors are merged before, with their number, so copies cost nothing. Links are counted in full but only those
that connect something new leave a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clearway.llm.common import cut
from clearway.llm.components import components
from clearway.llm.forest import Forest

# Vectors, chosen by a hash, that the centroids are fitted on.
FIT_VECTORS = 8192
ROUNDS = 8
MOST_CELLS = 256
# Vectors of one block and the components they may have together; two blocks are compared at once.
BLOCK = 4096
BLOCK_NUMBERS = 1 << 20


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix; shorter lists are filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def spherical_kmeans(vectors: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors; an emptied cell keeps its centroid."""
    rng = np.random.default_rng(seed)
    centroids = vectors[rng.choice(len(vectors), cells, replace=False)].copy()
    for _ in range(rounds):
        home = (vectors @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, vectors)
        norms = np.linalg.norm(sums, axis=1)
        centroids[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return centroids


def cells_of(vectors: np.ndarray, centroids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each unit vector and, as a mask, the later cells it visits.

    A partner at home in ``b`` is at least as near to ``b`` as to the home ``a``. Within the angle of the threshold there can be
    such a vector only if x . (a - b) / |a - b| is at most the sine of that angle.
    """
    products = vectors @ centroids.T
    home = products.argmax(axis=1)
    apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * centroids @ centroids.T))
    margin = products[np.arange(len(vectors)), home][:, None] - products
    reach = math.sqrt(max(0.0, 1.0 - threshold * threshold)) if threshold > 0 else 1.0
    visits = margin <= reach * apart[home] + 1e-9
    return home, visits & (np.arange(len(centroids))[None, :] > home[:, None])


def block_links(a: np.ndarray, b: np.ndarray | None, count_a: np.ndarray, count_b: np.ndarray | None, threshold: float):
    """Linked rows per vector, weighted by their numbers, and the connecting pairs, of two blocks or (b is None) within one."""
    other, weights, shift = (a, count_a, 0) if b is None else (b, count_b, len(a))
    forest = Forest(len(a) + (0 if b is None else len(b)))
    links = np.zeros(len(forest.label), dtype=np.int64)
    for at in range(0, len(a), 512):
        near = a[at: at + 512] @ other.T >= threshold
        rows = np.arange(len(near))
        if b is None:
            near[rows, at + rows] = False
        links[at: at + len(near)] += near @ weights
        if b is not None:
            links[shift:] += count_a[at: at + len(near)] @ near
        for i in np.flatnonzero(near.any(axis=1)):
            forest.join(at + int(i), np.flatnonzero(near[i]) + shift)
    return links, forest.links


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
                    cells: int | None = None, block: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Rows link if the cosine of their vectors, in double precision, reaches ``threshold``; equal vectors always do. The component is the smallest
    id reachable; the row with that id is kept. Rows with a null id and vectors that are null, empty, zero or hold null or
    non-finite components link with nothing and are their own component. Shorter vectors count as filled up with zeros.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("id").isNotNull() & F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    distinct = cut(
        rows.where(usable).groupBy("vec").agg(F.min("id").alias("node"), F.count("*").alias("copies")).withColumn("hash", F.xxhash64("vec"))
    )
    n, width = distinct.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))

    block = block or max(64, min(BLOCK, BLOCK_NUMBERS // width))
    share = min(1.0, FIT_VECTORS / n)
    sample = distinct.where(F.pmod(F.xxhash64("hash"), F.lit(1 << 30)) < math.ceil(share * (1 << 30))).select("vec").toArrow()["vec"].combine_chunks()
    sample = _unit(_matrix(sample, width)) if len(sample) else np.eye(1, width)
    k = min(len(sample), cells or max(1, min(MOST_CELLS, round(math.sqrt(n) / 8))))
    centroids = spherical_kmeans(sample, k)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                home, visits = cells_of(_unit(_matrix(part["vec"], width)), centroids, threshold)
                cells = pa.array([np.flatnonzero(v).astype(np.int32) for v in visits], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part["vec"], part["node"], part["copies"], part["hash"], pa.array(home.astype(np.int32)), cells],
                                                 names=["vec", "node", "copies", "hash", "home", "visits"])

    assigned = cut(distinct.mapInArrow(placed, "vec array<double>, node long, copies long, hash long, home int, visits array<int>"))
    roles = F.concat(
        F.array(F.struct(F.col("home").alias("cell"), F.lit(False).alias("visitor"))),
        F.transform("visits", lambda c: F.struct(c.alias("cell"), F.lit(True).alias("visitor"))),
    )
    # Two rows per cell: how many blocks its inhabitants and its visitors make.
    sizes = assigned.select(F.explode(roles).alias("r")).groupBy("r.cell").agg(
        F.ceil(F.sum((~F.col("r.visitor")).cast("long")) / block).cast("int").alias("own_blocks"),
        F.ceil(F.sum(F.col("r.visitor").cast("long")) / block).cast("int").alias("visitor_blocks"),
    )
    member = assigned.withColumn("r", F.explode(roles)).select("vec", "node", "copies", "hash", "r.cell", "r.visitor").join(F.broadcast(cut(sizes)), "cell")
    own, guests = F.col("own_blocks"), F.col("visitor_blocks")
    # Blocks of inhabitants are numbered from 0, of visitors from -1 down. An inhabitant meets all blocks, a visitor those of inhabitants.
    number = F.when(F.col("visitor"), -1 - F.pmod(F.xxhash64("hash", "cell"), guests)).otherwise(F.pmod(F.xxhash64("hash", "cell"), own)).cast("int")
    met = F.when(F.col("visitor"), F.sequence(F.lit(0), own - 1)).otherwise(F.sequence(-guests, own - 1))
    meeting = (
        member.where(own > 0).withColumn("number", number).withColumn("met", F.explode(met))
        .withColumn("low", F.least("number", "met")).withColumn("high", F.greatest("number", "met"))
        .select("cell", "low", "high", "number", "vec", "node", "copies", "hash")
    )

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        number = rows["number"].to_numpy()
        low, high = key[1].as_py(), key[2].as_py()
        node, hashes, copies = (rows[c].to_numpy() for c in ("node", "hash", "copies"))
        unit = _unit(_matrix(rows["vec"].combine_chunks(), width))
        if low == high:
            links, pairs = block_links(unit, None, copies, None, threshold)
            order = np.arange(len(unit))
        else:
            first, second = np.flatnonzero(number == low), np.flatnonzero(number == high)
            order = np.concatenate([first, second])
            links, pairs = block_links(unit[first], unit[second], copies[first], copies[second], threshold)
        some = np.flatnonzero(links)
        ends = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        none = np.zeros(len(ends), dtype=np.int64)
        return pa.table({
            "a": np.concatenate([node[order[some]], node[order[ends[:, 0]]]]), "hash": np.concatenate([hashes[order[some]], none]),
            "links": np.concatenate([links[some], none]), "b": pa.array(np.concatenate([np.zeros(len(some), np.int64), node[order[ends[:, 1]]]])),
        })

    found = cut(meeting.groupBy("cell", "low", "high").applyInArrow(compare, "a long, hash long, links long, b long"))
    counted = cut(found.where("links > 0").groupBy(F.col("a").alias("node"), "hash").agg(F.sum("links").alias("links")))
    grouped = cut(components(found.where("links = 0").select("a", "b")))
    named = cut(
        distinct.join(counted, ["node", "hash"], "left").join(grouped, "node", "left")
        .select("vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    linked = rows.where(usable).join(named, "vec").select("id", "n_links", "component")
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
