"""Hand-known geometry: one scene per case, all cases in one job."""

import math

import pytest

from clearway.operators import frame_metrics as fm
from clearway.operators.obstacles import pillar_voxels
from scene_rows import by_scene

INF = math.inf
E20 = {"ego": (20, 20), "speed": 10}
NEEDS = fm.Needs(True, True, (0.0, 0.5, 2.0), (0.5,), ("vehicle", None), True)


def build(scenes):
    b = scenes()
    b.frame("offset", cells=[(5, 2, 2)])
    b.frame("minimum", cells=[(5, 3, 2), (8, 1, 2)])
    b.frame("turned", cells=[(20, 25, 2)], ego=(20, 20), heading=math.pi / 2)
    b.frame("gap", cells=[(5, 3, 2)])
    b.frame("dead_ahead", cells=[(5, 0, 2)])
    b.frame("empty")
    b.frame("ground", cells=[(5, 1, 0)])
    b.frame("overhead", cells=[(5, 1, 5)])
    b.frame("behind", cells=[(15, 21, 2)], ego=(20, 20))
    b.frame("here", cells=[(25, 23, 2)], ego=(20, 20))
    b.frame("moved", cells=[(25, 23, 2)], ego=(120, 120), origin=(100, 100, 0))
    b.frame("unknown", cells=[(5, 3, 2, -1)])
    b.frame("both", cells=[(5, 3, 2, -1), (5, 3, 2, 1), (5, 3, 2, 1)])
    b.frame("path_empty", **E20)
    b.frame("path_blocked", cells=[(25, 20, 2)], **E20)
    b.frame("path_outside", cells=[(25, 25, 2)], **E20)
    b.frame("path_beyond", cells=[(39, 20, 2)], **E20)
    b.frame("path_body", cells=[(21, 20, 2)], **E20)
    b.frame("path_unknown", cells=[(25, 20, 2, -1)], **E20)
    b.frame("width_even", cells=[(i, j, 2) for i in range(21, 28) for j in (22, 18)], **E20)
    b.frame("width_uneven", cells=[(24, 22, 2), (24, 17, 2)], **E20)
    b.frame("width_narrowing", cells=[(22, 23, 2), (22, 17, 2), (25, 21, 2), (25, 19, 2)], **E20)
    b.frame("width_one_sided", cells=[(i, 22, 2) for i in range(21, 28)], **E20)
    b.frame("width_overlap", cells=[(24, j, 2) for j in (19, 20, 21)], **E20)
    b.frame("boxed", boxes=[((3, 4, 1), "vehicle"), ((1, 0, 1), "cone")], ego=(0, 0))
    return b


@pytest.fixture(scope="module")
def metrics(spark):
    from scene_rows import Builder

    b = build(lambda: Builder(spark))
    return by_scene(fm.frame_metrics(b.frames, b.voxels, b.boxes, NEEDS))


@pytest.mark.parametrize("scene, column, expected", [
    ("offset", "centerline_free", 2.0),
    ("minimum", "centerline_free", 1.0),
    ("turned", "centerline_free", 0.0),
    ("gap", "clearance_free", 1.575),
    ("dead_ahead", "clearance_free", INF),
    ("dead_ahead", "centerline_free", 0.0),
    ("empty", "clearance_free", INF),
    ("empty", "centerline_occupied", INF),
    ("ground", "clearance_free", INF),
    ("overhead", "clearance_free", INF),
    ("behind", "clearance_free", INF),
    ("here", "clearance_free", 1.575),
    ("moved", "clearance_free", 1.575),
    ("unknown", "clearance_free", INF),
    ("unknown", "clearance_occupied", 1.575),
    ("both", "clearance_free", 1.575),
    ("path_empty", "path_free_2s_free", True),
    ("path_blocked", "path_free_2s_free", False),
    ("path_outside", "path_free_2s_free", True),
    ("path_beyond", "path_free_0p5s_free", True),
    ("path_beyond", "path_free_2s_free", False),
    ("path_body", "path_free_0s_free", False),
    ("path_unknown", "path_free_2s_free", True),
    ("path_unknown", "path_free_2s_occupied", False),
    ("width_even", "free_width_0p5s_free", 3.0),
    ("width_uneven", "free_width_0p5s_free", 4.0),
    ("width_narrowing", "free_width_0p5s_free", 1.0),
    ("width_one_sided", "free_width_0p5s_free", INF),
    ("empty", "free_width_0p5s_occupied", INF),
    ("width_overlap", "free_width_0p5s_free", 1.0),
    ("boxed", "box_distance_vehicle", 5.0),
    ("boxed", "box_distance", 1.0),
    ("empty", "box_distance", INF),
    ("boxed", "ego_width", 1.85),
])
def test_metric(metrics, scene, column, expected):
    value = metrics[scene][column]
    assert value == expected if isinstance(expected, bool) or expected == INF else value == pytest.approx(expected, abs=1e-9)


def test_every_frame_has_a_row_and_policies_are_ordered(metrics):
    assert len(metrics) == 25
    for r in metrics.values():
        assert r["clearance_occupied"] <= r["clearance_free"]
        assert r["centerline_occupied"] <= r["centerline_free"]
        assert r["free_width_0p5s_occupied"] <= r["free_width_0p5s_free"]
        assert r["path_free_2s_free"] or not r["path_free_2s_occupied"]


def test_sub_voxel_gap_reads_as_closed(scenes):
    # The ego centre lies inside the left cell, 3 cm from the face of the right one: less than one voxel.
    b = scenes(voxel=0.2)
    b.frame("sliver", cells=[(55, 51, 5), (55, 50, 5)], ego=(10, 10.13), speed=1)
    row = by_scene(fm.frame_metrics(b.frames, b.voxels, None, fm.Needs(width_horizons=(2.0,))))["sliver"]
    assert row["free_width_2s_free"] == 0.0


def test_station_membership_is_exact_on_the_real_grid(spark, scenes):
    """With 0.4 m voxels every layer lies half-way between two stations; doubles decide, as in a loop."""
    b = scenes(voxel=0.4, origin=(-39.8, -39.8, -0.8), ground=-1.0)
    b.frame("real", cells=[(i, 95, 2) for i in range(100, 200)] + [(i, 104, 2) for i in range(100, 200)], speed=30)
    from clearway.operators.obstacles import ego_obstacles

    rows = fm.by_station(ego_obstacles(b.voxels, b.frames), keep_all=False).select("i", "station").distinct().collect()
    expected = set()
    for i in range(100, 200):
        fwd = (-39.8 + i * 0.4) - 0.0
        fwd = fwd * 1.0 + 0.0
        for k in range(0, 300):
            if abs(fwd - k * 0.4) <= 0.2:
                expected.add((i, k))
    assert {(r["i"], r["station"]) for r in rows} == expected


def test_random_scenes_match_a_direct_loop(spark, scenes):
    """Brute force over random headings and cells, written as plain loops."""
    import random

    rng = random.Random(7)
    b = scenes(voxel=0.5, origin=(-10.0, -10.0, 0.0), ground=0.25)
    want = {}
    for n in range(40):
        heading, speed = rng.uniform(-3, 3), rng.uniform(0, 12)
        cells = list({(rng.randrange(40), rng.randrange(40), rng.randrange(7)) for _ in range(rng.randrange(60))})
        cells = [(*c, rng.choice((1, -1))) for c in cells]
        ego = (rng.uniform(-2, 2), rng.uniform(-2, 2))
        b.frame(f"r{n}", cells=cells, ego=ego, heading=heading, speed=speed)
        for policy in ("free", "occupied"):
            points = []
            for i, j, k, state in cells:
                z = k * 0.5
                if (state == 1 or policy == "occupied") and 0.25 < z <= 0.25 + 1.9:
                    dx, dy = -10 + i * 0.5 - ego[0], -10 + j * 0.5 - ego[1]
                    c, s = math.cos(heading), math.sin(heading)
                    points.append((dx * c + dy * s, dx * -s + dy * c))
            half = 1.85 / 2 + 0.25
            ahead = [lat for fwd, lat in points if 0 <= fwd <= 20]
            centre = min(map(abs, ahead), default=INF)
            side = min((abs(x) - half for x in ahead if abs(x) > half), default=INF)
            free = not any(0 <= f <= 2.3 + speed + 0.25 and abs(lat) <= half for f, lat in points)
            widths, k = [], 0
            while k * 0.5 <= 2.3 + speed * 2.0 + 1e-9:
                near = [lat for f, lat in points if abs(f - k * 0.5) <= 0.25]
                left, right = [x for x in near if x > 0], [x for x in near if x < 0]
                if left and right:
                    widths.append(max(0.0, min(left) - 0.25) + max(0.0, -max(right) - 0.25))
                k += 1
            w = min(widths, default=INF)
            want[f"r{n}", policy] = (centre, side, free, 0.0 if w < 0.5 else w)
    needs = fm.Needs(True, True, (1.0,), (2.0,))
    for voxels in (b.voxels, pillar_voxels(b.voxels, b.frames)):
        got = by_scene(fm.frame_metrics(b.frames, voxels, None, needs))
        for (scene, policy), (centre, side, free, width) in want.items():
            r = got[scene]
            assert r[f"centerline_{policy}"] == pytest.approx(centre)
            assert r[f"clearance_{policy}"] == pytest.approx(side)
            assert r[f"path_free_1s_{policy}"] == free
            assert r[f"free_width_2s_{policy}"] == pytest.approx(width)


def test_abeam_limit(scenes):
    b = scenes().frame("far", cells=[(9, 3, 2)]).frame("near", cells=[(2, 3, 2)])
    got = by_scene(fm.frame_metrics(b.frames, b.voxels, None, fm.Needs(clearance=True, abeam=3.0)))
    assert got["far"]["clearance_free"] == INF and got["near"]["clearance_free"] == pytest.approx(1.575)


def test_stored_pose_columns_make_the_join_unnecessary(scenes):
    b = build(scenes)
    stored = b.voxels.join(b.frames.drop("time_s", "ez", "heading"), ["scene", "t"])
    got = by_scene(fm.frame_metrics(b.frames, stored, b.boxes, NEEDS))
    plain = by_scene(fm.frame_metrics(b.frames, b.voxels, b.boxes, NEEDS))
    assert got == plain
