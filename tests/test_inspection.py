import random

import pytest
from pyspark.sql import functions as F

from clearway import schemas
from clearway.operators import frame_metrics as fm
from clearway.operators import inspection
from scene_rows import by_scene


def test_frame_picks(spark):
    inf = float("inf")
    rows = [
        # scene, t, speed, clearance, path free, width, ego width
        ("match", 0, 1.0, 0.3, True, 0.0, 1.85), ("match", 1, 9.0, 0.5, False, 1.5, 1.85), ("match", 2, 9.0, 0.4, True, 1.0, 1.85),
        ("none", 0, 1.0, 2.0, True, 3.0, 1.85), ("none", 1, 1.0, 1.0, True, 2.0, 1.85), ("none", 2, 1.0, 1.0, True, 2.0, 1.85),
        ("open", 0, 1.0, inf, True, inf, 1.85), ("open", 1, 1.0, inf, True, inf, 1.85),
    ]
    df = spark.createDataFrame(rows, (
        "scene STRING, t INT, speed DOUBLE, clearance_free DOUBLE, path_free_1s_free BOOLEAN, free_width_2s_free DOUBLE, ego_width DOUBLE"
    ))
    got = {r["scene"]: (r["corridor"], r["blocked"], r["tight"], r["default"]) for r in inspection.pick_frames(df).collect()}
    assert got == {"match": (2, 1, 2, 0), "none": (1, 0, 1, 1), "open": (0, 0, 0, 0)}


def test_witnesses(scenes):
    b = scenes()
    ego = {"ego": (20, 20), "speed": 10}
    b.frame("narrowing", cells=[(22, 23, 2), (22, 17, 2), (25, 21, 2), (25, 19, 2), (23, 21, 2), (23, 19, 2)], **ego)
    b.frame("one_sided", cells=[(22, 23, 2), (24, 23, 2)], **ego)
    side = by_scene(inspection.clearance_witness(b.voxels, b.frames))
    assert (side["one_sided"]["i"], side["one_sided"]["j"], side["one_sided"]["fwd"]) == (22, 23, 2.0)
    # The cells beside the corridor at lateral 3 count, the ones inside it do not.
    assert (side["narrowing"]["i"], side["narrowing"]["j"]) == (22, 17)
    gate = by_scene(inspection.corridor_witness(b.voxels, b.frames))
    assert set(gate) == {"narrowing"}
    r = gate["narrowing"]
    assert (r["station"], r["at"], r["left"], r["right"], r["gap"]) == (3, 3.0, 0.5, -0.5, 1.0)


def test_witness_pair(spark, scenes):
    """Two scenes with equal boxes; only one has an unboxed wall."""
    b = scenes(voxel=0.2)
    ego = {"ego": (10, 10), "speed": 10, "boxes": [((10, 30, 1), "vehicle")]}
    wall = [(round((10 + f) / 0.2), round((10 + 1.425) / 0.2), 5) for f in range(3, 9)]
    b.frame("clear", **ego)
    b.frame("wall", cells=wall, **ego)
    b.frame("other", cells=wall, ego=(10, 10), speed=10, boxes=[((10, 31, 1), "vehicle")])
    b.frame("twice", cells=wall, ego=(10, 10), speed=10, boxes=[((10, 30, 1), "vehicle"), ((10, 30, 1), "vehicle")])
    m = fm.frame_metrics(b.frames, b.voxels, b.boxes, fm.Needs(clearance=True, labels=("vehicle",)))
    rows = by_scene(m)
    assert rows["clear"]["box_distance_vehicle"] == rows["wall"]["box_distance_vehicle"]
    assert rows["clear"]["clearance_free"] == float("inf") and rows["wall"]["clearance_free"] < 0.5
    answers = m.groupBy("scene").agg(F.max(F.col("clearance_free") < 0.5).alias("answer"))
    got = inspection.indistinguishable_units(answers, b.boxes, ["scene"]).collect()
    assert {(r["scene"], r["answer"], r["group_size"]) for r in got} == {("clear", False, 2), ("wall", True, 2)}


def hashes_that_clash(counted, keys):
    """Every unit with as many boxes has the same fingerprint."""
    return inspection.box_fingerprint(counted, keys).withColumns({"h1": F.lit(1).cast("long"), "h2": F.lit(2).cast("long")})


@pytest.mark.parametrize("fingerprint", [inspection.box_fingerprint, hashes_that_clash])
def test_boxes_decide_and_not_their_hashes(spark, fingerprint):
    """Random units of two boxes from a small stock, nulls and repeats among them, against a comparison of lists."""
    rng = random.Random(3)
    stock = [(float(x), label) for x in (0, 1) for label in ("car", None)]
    units = {f"s{n}": ([rng.choice(stock) for _ in range(rng.choice((0, 2, 2, 2)))], rng.random() < 0.3) for n in range(60)}
    rows = [(s, 0, n, x, 0.0, 0.0, 4.5, 2.0, 1.8, 0.0, label, 0.0, 0.0) for s, (boxes, _) in units.items() for n, (x, label) in enumerate(boxes)]
    boxes = spark.createDataFrame(rows, schemas.BOXES)
    answers = spark.createDataFrame([(s, answer) for s, (_, answer) in units.items()], "scene STRING, answer BOOLEAN")
    groups = {}
    for s, (own, answer) in units.items():
        groups.setdefault(tuple(sorted(own, key=repr)), []).append((s, answer))
    want = {
        (s, answer, len(seen), len(group), sum(a for _, a in group))
        for seen, group in groups.items() if len({a for _, a in group}) == 2 for s, answer in group
    }
    got = inspection.indistinguishable_units(answers, boxes, ["scene"], fingerprint=fingerprint).collect()
    assert len(got) == len(want) > 20
    assert {(r["scene"], r["answer"], r["n_boxes"], r["group_size"], r["group_matches"]) for r in got} == want


def test_scenes_are_told_apart_by_the_frame_of_a_box(spark):
    rows = [(s, t, 0, 1.0, 0.0, 0.0, 4.5, 2.0, 1.8, 0.0, "car", 0.0, 0.0) for s, t in (("a", 0), ("b", 0), ("c", 1))]
    answers = spark.createDataFrame([("a", True), ("b", False), ("c", False), ("d", True)], "scene STRING, answer BOOLEAN")
    got = inspection.indistinguishable_units(answers, spark.createDataFrame(rows, schemas.BOXES), ["scene"]).collect()
    assert {(r["scene"], r["group_size"]) for r in got} == {("a", 2), ("b", 2)}


def test_clearance_witness_with_any_index(spark, scenes):
    """Negative and very large indices come back as they were."""
    far = 3_000_000
    for cells in ([(5, -3, 2), (5, 9, 2)], [(far, far - 3, 2)], [(-far, -far + 3, 2)]):
        i, j, _ = cells[0]
        b = scenes().frame("s", cells=cells, origin=(-float(i), -float(j) - 3.0, 0.0))
        (w,) = inspection.clearance_witness(b.voxels, b.frames).collect()
        assert (w["i"], w["j"], w["k"]) == cells[0]
