import random
import subprocess
import sys

import pytest
from pyspark import cloudpickle

from clearway import schemas
from clearway.operators import rays
from clearway.sources import label_volumes


def march(src, dst):
    """Step-by-step reference for one ray, in plain loops."""
    pos, out = list(src), []
    span = [abs(d - s) for s, d in zip(src, dst)]
    sign = [(d > s) - (d < s) for s, d in zip(src, dst)]
    crossing = [0.5 / n if n else float("inf") for n in span]
    while sum(abs(d - p) for p, d in zip(pos, dst)) > 1:
        axis = crossing.index(min(crossing))
        pos[axis] += sign[axis]
        crossing[axis] += 1.0 / span[axis]
        out.append(tuple(pos))
    return out


def table(spark, ends):
    return spark.createDataFrame([(n, "s", 0, *a, *b) for n, (a, b) in enumerate(ends)], schemas.RAYS)


def cells(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["ray_id"], r["pos"])):
        out.setdefault(r["ray_id"], []).append((r["i"], r["j"], r["k"]))
    return out


def test_known_rays(spark):
    ends = [((0, 0, 0), (3, 0, 0)), ((1, 1, 1), (1, 1, 1)), ((0, 0, 0), (1, 0, 0)), ((0, 0, 0), (2, 2, 0)), ((3, 0, 0), (0, 0, 0))]
    got = cells(rays.ray_cells(table(spark, ends)))
    assert got == {0: [(1, 0, 0), (2, 0, 0)], 3: [(1, 0, 0), (1, 1, 0), (2, 1, 0)], 4: [(2, 0, 0), (1, 0, 0)]}


def test_cells_match_single_steps(spark):
    rng = random.Random(3)
    ends = [((0, 0, 0), (0, 1, 7)), ((0, 0, 0), (3, 3, 3)), ((5, 5, 5), (-4, 2, 9))]
    for _ in range(400):
        ends.append((tuple(rng.randrange(-20, 20) for _ in range(3)), tuple(rng.randrange(-20, 20) for _ in range(3))))
    got = cells(rays.ray_cells(table(spark, ends)))
    for n, (a, b) in enumerate(ends):
        assert got.get(n, []) == march(a, b), (a, b)


def test_segments_hold_the_same_cells(spark):
    rng = random.Random(9)
    ends = [((0, 0, 0), (150, 3, 2)), ((63, 0, 0), (64, 5, 0)), ((2, 2, 2), (2, 2, 2)), ((130, 1, 1), (-70, 0, 4))]
    ends += [tuple(tuple(rng.randrange(-90, 90) for _ in range(3)) for _ in range(2)) for _ in range(100)]
    got = {}
    for r in rays.ray_segments(table(spark, ends)).collect():
        for b in range(64):
            if (r["path"] >> b) & 1:
                cell = (r["segment"] * 64 + b, r["j"], r["k"])
                assert cell not in got.setdefault(r["ray_id"], set())
                got[r["ray_id"]].add(cell)
    assert got == {n: set(march(a, b)) for n, (a, b) in enumerate(ends) if march(a, b)}


CASES = {
    "clear": ([], True, True, 0),
    "blocked": ([(4, 0, 0, 1)], False, False, 1),
    "endpoint": ([(7, 0, 0, 1), (0, 0, 0, 1)], True, True, 0),
    "unknown": ([(4, 0, 0, -1)], True, False, 0),
    "two": ([(3, 0, 0, 1), (5, 0, 0, 1)], False, False, 2),
    "copies": ([(3, 0, 0, 1), (3, 0, 0, 1), (3, 0, 0, -1)], False, False, 1),
}


@pytest.fixture
def world(spark):
    voxels = spark.createDataFrame([(s, 0, *c) for s, (cs, *_) in CASES.items() for c in cs], schemas.VOXELS)
    rows = spark.createDataFrame([(n, s, 0, 0, 0, 0, 7, 0, 0) for n, s in enumerate(CASES)], schemas.RAYS)
    return rows, voxels


def test_occlusion(world):
    got = {r["scene"]: (r["visible"], r["visible_unknown_blocks"], r["depth"]) for r in rays.occlusion(*world).collect()}
    assert got == {s: tuple(want) for s, (_, *want) in CASES.items()}


def test_line_of_sight(world):
    seen = {r["scene"] for r in rays.line_of_sight(*world).collect()}
    assert seen == {s for s, (_, v, _, _) in CASES.items() if v}
    strict = {r["scene"] for r in rays.line_of_sight(*world, unknown_blocks=True).collect()}
    assert strict == {s for s, (_, _, v, _) in CASES.items() if v}
    unknown_only = {r["scene"] for r in rays.line_of_sight(*world, occupied_value=-1).collect()}
    assert unknown_only == set(CASES) - {"unknown"}
    assert {r["scene"] for r in rays.line_of_sight(*world, occupied_value=0).collect()} == set()


def test_workers_need_no_copy_of_the_package():
    sent = cloudpickle.dumps((rays._segment_rows, label_volumes._cells))
    code = "import pickle, sys; print([f.__name__ for f in pickle.load(sys.stdin.buffer)], 'clearway' in sys.modules)"
    out = subprocess.run([sys.executable, "-c", code], input=sent, capture_output=True, cwd="/", env={"PATH": ""}, check=True)
    assert out.stdout.decode().strip() == "['_segment_rows', '_cells'] False"


def test_rays_without_voxels(spark, world):
    rows, voxels = world
    assert rays.line_of_sight(rows, voxels.limit(0)).count() == len(CASES)
