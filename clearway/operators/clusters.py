"""Connected clusters of cells, and the noise filter that wants a least cluster size.

Rows of cells travel as bit masks. All frames of a batch are solved together with numpy: the runs of each row are sorted once, a
run finds the runs it touches in the four next rows by two binary searches, and labels sink to the smallest run of a cluster.
No pair of cells is ever made; what a task holds is a batch of masks and the rest of one frame, which the grid bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clearway.functions.occupancy import OCCUPIED, UNKNOWN
from clearway.operators.obstacles import SEGMENT_CELLS, cell_masks
from clearway.schemas import FRAME_KEY

# Rows of which each pair of touching rows is met once, and how far along i cells may be apart to touch.
DIAGONAL_ROWS = ((1, 0), (-1, 1), (0, 1), (1, 1))
STRAIGHT_ROWS = ((1, 0), (0, 1))
CELLS_PER_BATCH = 1_000_000


def set_bits(segment: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the arguments, i) of every set bit."""
    bits = np.unpackbits(mask.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(bits)
    return at, segment[at].astype(np.int64) * SEGMENT_CELLS + bit


def label_cells(frame: np.ndarray, i: np.ndarray, j: np.ndarray, k: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Clusters of distinct cells in numbered frames.

    Returns an order of the cells (by frame, k, j, i), the number of the cluster of each ordered cell, and for each cluster its
    number of cells. Clusters are numbered by their smallest cell in that order.
    """
    low = [int(x.min(initial=0)) for x in (i, j, k)]
    width, depth, height = (int(x.max(initial=0)) - m + 3 for x, m in zip((i, j, k), low))
    if (int(frame.max(initial=0)) + 1) * width * depth * height >= 1 << 62:
        raise ValueError(f"cells of one batch span {width} x {depth} x {height}; they cannot be numbered in 64 bits")
    # A margin of one empty cell on each side keeps rows, layers and frames apart.
    code = ((frame.astype(np.int64) * height + (k.astype(np.int64) - low[2] + 1)) * depth + (j.astype(np.int64) - low[1] + 1)) * width + (i - low[0] + 1)
    order = np.argsort(code, kind="stable")
    code = code[order]
    heads = np.flatnonzero(np.concatenate([[True], np.diff(code) != 1])) if len(code) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, len(code)))
    first, last = code[heads], code[heads] + sizes - 1
    edges = []
    for dj, dk in DIAGONAL_ROWS if diagonal else STRAIGHT_ROWS:
        shift = (dk * depth + dj) * width
        begin = np.searchsorted(last, first + shift - diagonal)
        end = np.searchsorted(first, last + shift + diagonal, side="right")
        count = np.maximum(end - begin, 0)
        a = np.repeat(np.arange(len(first)), count)
        edges.append(np.stack([a, np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + begin[a]]))
    run = lowest_labels(len(first), *np.concatenate(edges, axis=1))
    roots, number = np.unique(run, return_inverse=True)
    return order, np.repeat(number, sizes), np.bincount(number, sizes, minlength=len(roots)).astype(np.int64)


def lowest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node it is connected to over the edges (a, b)."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        # Only roots are moved, so no link that was found before is lost.
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def frame_numbers(rows: pa.Table) -> np.ndarray:
    """Which frame each of the sorted rows is of, counted from 0."""
    changes = np.zeros(rows.num_rows, dtype=bool)
    for key in FRAME_KEY:
        code = rows[key].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        changes[1:] |= code[1:] != code[:-1]
    return np.cumsum(changes)


def clustered_cells(voxels: DataFrame, *, min_cells: int = 1, diagonal: bool = True) -> DataFrame:
    """Cells of clusters of at least ``min_cells`` cells, with the size and the first cell of their cluster.

    Cells of one frame and state that touch, also over an edge or corner if ``diagonal``, are a cluster; its first cell is the one with the
    smallest (k, j, i). Copies of a cell count once, and an OCCUPIED one wins over an UNKNOWN one. Columns: scene, t, i, j, k, state,
    cells, first_i, first_j, first_k.
    """
    masks = cell_masks(voxels)
    sorted_masks = masks.repartition(*FRAME_KEY).sortWithinPartitions(*FRAME_KEY)
    key_type = dict(voxels.dtypes)
    schema = f"scene {key_type['scene']}, t {key_type['t']}, i int, j int, k int, state int, cells long, first_i int, first_j int, first_k int"
    names = ["scene", "t", "i", "j", "k", "state", "cells", "first_i", "first_j", "first_k"]

    def solve(rows: pa.Table, frame: np.ndarray) -> Iterator[pa.RecordBatch]:
        j, k, segment = (rows[c].to_numpy() for c in ("j", "k", "segment"))
        for state, column in ((OCCUPIED, "occupied"), (UNKNOWN, "unknown")):
            at, i = set_bits(segment, rows[column].to_numpy())
            if not len(at):
                continue
            order, cluster, sizes = label_cells(frame[at], i, j[at], k[at], diagonal)
            at, i = at[order], i[order]
            # Cells are in order, so the first cell met of a cluster is its first cell.
            _, head = np.unique(cluster, return_index=True)
            kept = np.flatnonzero(sizes[cluster] >= min_cells)
            first, size = head[cluster[kept]], sizes[cluster[kept]]
            here = at[kept]
            cells = [i[kept], j[here], k[here], np.full(len(kept), state)]
            firsts = [i[first], j[at[first]], k[at[first]]]
            columns = [pa.array(c, pa.int32()) for c in (*cells, *firsts)]
            columns.insert(4, pa.array(size))
            keys = [rows[c].take(pa.array(here)).combine_chunks() for c in FRAME_KEY]
            for start in range(0, len(kept), CELLS_PER_BATCH):
                yield pa.RecordBatch.from_arrays([c.slice(start, CELLS_PER_BATCH) for c in (*keys, *columns)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
            frame = frame_numbers(rows)
            done = int(np.searchsorted(frame, frame[-1])) if len(frame) else 0
            if done:
                yield from solve(rows.slice(0, done), frame[:done])
            rest = rows.slice(done)
        if rest is not None and rest.num_rows:
            yield from solve(rest, frame_numbers(rest))

    return sorted_masks.mapInArrow(run, schema)


def clusters(voxels: DataFrame, *, min_cells: int = 1, diagonal: bool = True) -> DataFrame:
    """One row per cluster: its first cell, its number of cells and the box around it."""
    cells = clustered_cells(voxels, min_cells=min_cells, diagonal=diagonal)
    return cells.groupBy(*FRAME_KEY, "state", "first_i", "first_j", "first_k").agg(
        F.first("cells").alias("cells"),
        *[f(c).alias(f"{c}_{n}") for c in "ijk" for n, f in (("min", F.min), ("max", F.max))],
    )


def without_small_clusters(voxels: DataFrame, min_cells: int, *, diagonal: bool = True) -> DataFrame:
    """The voxel table without cells of clusters of fewer than ``min_cells`` cells: what stands alone does not block."""
    return clustered_cells(voxels, min_cells=min_cells, diagonal=diagonal).select(*FRAME_KEY, "i", "j", "k", "state")
