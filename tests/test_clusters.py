import random

import numpy as np
import pytest

from clearway.operators import clusters
from clearway.schemas import VOXELS


def brute(cells, diagonal):
    """(scene, t, state, cell) -> (size, first cell) by flood fill."""
    state = {}
    for scene, t, i, j, k, s in cells:
        state[scene, t, i, j, k] = max(s, state.get((scene, t, i, j, k), -1))
    groups, seen = {}, set()
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0) and (diagonal or abs(a) + abs(b) + abs(c) == 1)]
    for start, s in state.items():
        if start in seen:
            continue
        seen.add(start)
        group, todo = [], [start]
        while todo:
            scene, t, i, j, k = todo.pop()
            group.append((i, j, k))
            for a, b, c in steps:
                near = scene, t, i + a, j + b, k + c
                if near not in seen and state.get(near) == s:
                    seen.add(near)
                    todo.append(near)
        first = min(group, key=lambda c: (c[2], c[1], c[0]))
        groups.update({(*start[:2], *c, s): (len(group), *first) for c in group})
    return groups


def result(df):
    return {(r.scene, r.t, r.i, r.j, r.k, r.state): (r.cells, r.first_i, r.first_j, r.first_k) for r in df.collect()}


@pytest.mark.parametrize("diagonal", [True, False])
@pytest.mark.parametrize("fill", [0.03, 0.1, 0.35])
def test_equals_flood_fill(spark, fill, diagonal):
    rng = random.Random(int(fill * 100))
    cells = [
        (f"s{t % 3}", t, i, j, k, rng.choice((1, 1, -1)))
        for t in range(7) for i in range(55, 75) for j in range(-4, 8) for k in range(5) if rng.random() < fill
    ]
    cells += cells[:20] + [(*c[:5], 1) for c in cells[20:25]]
    df = spark.createDataFrame(cells, VOXELS).repartition(3)
    expected = brute(cells, diagonal)
    assert result(clusters.clustered_cells(df, diagonal=diagonal)) == expected
    assert result(clusters.clustered_cells(df, diagonal=diagonal, min_cells=4)) == {c: g for c, g in expected.items() if g[0] >= 4}
    boxes = clusters.clusters(df, diagonal=diagonal).collect()
    assert sum(r.cells for r in boxes) == len(expected)
    for r in boxes:
        members = [c for c, g in expected.items() if (*c[:2], c[5], *g) == (r.scene, r.t, r.state, r.cells, r.first_i, r.first_j, r.first_k)]
        for n, axis in enumerate("ijk", 2):
            assert (r[f"{axis}_min"], r[f"{axis}_max"]) == (min(c[n] for c in members), max(c[n] for c in members))


def test_clusters_over_segment_borders(spark):
    """A line of cells over three mask segments, a spiral that meets itself late, negative indices."""
    line = [("line", 0, i, 0, 0, 1) for i in range(-70, 140)]
    diagonal = [("diagonal", 0, 60 + d, d, d, 1) for d in range(10)]
    snake = [("snake", 1, i, j, 0, 1) for j in range(0, 21, 2) for i in range(50, 80)] + [("snake", 1, 50 if j % 4 == 1 else 79, j, 0, 1) for j in range(1, 20, 2)]
    cells = line + diagonal + snake
    got = result(clusters.clustered_cells(spark.createDataFrame(cells, VOXELS)))
    assert {g[0] for c, g in got.items() if c[0] == "line"} == {210}
    assert {g for c, g in got.items() if c[0] == "diagonal"} == {(10, 60, 0, 0)}
    assert {g[0] for c, g in got.items() if c[0] == "snake"} == {11 * 30 + 10}
    straight = result(clusters.clustered_cells(spark.createDataFrame(cells, VOXELS), diagonal=False))
    assert {g[0] for c, g in straight.items() if c[0] == "diagonal"} == {1}


def test_a_frame_over_many_batches(spark):
    """One frame is more mask rows than an Arrow batch holds, and others share its partition."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        cells = [("a", 0, 0, j, 0, 1) for j in range(200)] + [("a", t, 5, 3 * j, 0, 1) for t in (1, 2) for j in range(5)]
        got = result(clusters.clustered_cells(spark.createDataFrame(cells, VOXELS).coalesce(1)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {g[0] for c, g in got.items() if c[1] == 0} == {200}
    assert len(got) == 210 and {g[0] for c, g in got.items() if c[1]} == {1}


def test_empty_and_filtered(spark):
    df = spark.createDataFrame([("a", 0, 1, 1, 1, 1), ("a", 0, 2, 2, 1, 1), ("a", 0, 9, 9, 9, 1)], VOXELS)
    assert clusters.clustered_cells(df.limit(0)).collect() == []
    kept = clusters.without_small_clusters(df, 2)
    assert kept.columns == ["scene", "t", "i", "j", "k", "state"] and kept.count() == 2
    assert clusters.without_small_clusters(df, 2, diagonal=False).count() == 0


def test_labels_of_a_long_chain():
    n = 3000
    order = np.random.default_rng(2).permutation(n)
    labels = clusters.lowest_labels(n + 2, order[:-1], order[1:])
    assert set(labels[:n]) == {0} and labels[n:].tolist() == [n, n + 1]


def test_cells_too_far_apart_for_one_number():
    with pytest.raises(ValueError):
        far = np.array([0, 2_000_000_000])
        clusters.label_cells(np.zeros(2, np.int64), far, far, far)
