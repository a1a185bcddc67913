from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from clearway.operators import evaluation as ev
from clearway.operators import frame_metrics as fm
from clearway.operators import retrieval, temporal
from clearway.plans import catalogue as cat

WALL = [(12, j, 2) for j in (9, 10, 11)]


def sequence(b, scene, pattern):
    """Frames 'x' (blocked) and '.' (clear)."""
    for t, c in enumerate(pattern):
        b.frame(scene, t, cells=WALL if c == "x" else [], ego=(10, 10), speed=5)


@pytest.fixture(scope="module")
def metrics(spark):
    from scene_rows import Builder

    b = Builder(spark)
    for name, pattern in {
        "blocked_clear": "x.", "clear_blocked": ".x", "blocked": "xx", "clear": "..", "clear_blocked_clear": ".x.",
        "gap_of_three": "xxx.", "late": "x" + "x" * 3 + ".", "only_first": "x....",
    }.items():
        sequence(b, name, pattern)
    return fm.frame_metrics(b.frames, b.voxels, None, fm.Needs(path_horizons=(0.0,))).cache()


def path():
    return F.col("path_free_0s_free")


def names(df):
    return {r["scene"] for r in df.collect()}


def test_transition(metrics):
    got = names(retrieval.retrieve_transition(metrics, ~path(), path(), 3))
    assert got == {"blocked_clear", "clear_blocked_clear", "gap_of_three", "late", "only_first"}


@pytest.mark.parametrize("within", [1, 2, 3])
def test_transition_equals_the_join_form(metrics, within):
    window = names(retrieval.retrieve_transition(metrics, ~path(), path(), within))
    assert window == names(temporal.transition_hits_by_join(metrics, ~path(), path(), within))


def test_within_boundary(spark):
    rows = [("exact", 0, False), ("exact", 3, True), ("over", 0, False), ("over", 4, True)]
    for scene, n in (("exact", 3), ("over", 4)):
        rows += [(scene, t, None) for t in range(1, n)]
    frames = spark.createDataFrame(rows, "scene STRING, t INT, free BOOLEAN")
    hits = retrieval.retrieve_transition(frames, F.col("free") == False, F.col("free") == True, 3)  # noqa: E712
    assert names(hits) == {"exact"}


def test_any_and_all(metrics):
    assert names(retrieval.retrieve_where(metrics, ~path(), "any")) >= {"clear_blocked"}
    assert "clear" not in names(retrieval.retrieve_where(metrics, ~path(), "any"))
    assert names(retrieval.retrieve_where(metrics, path(), "all")) == {"clear"}


def test_scene_without_frames(spark, metrics):
    scenes = spark.createDataFrame([("clear",), ("nothing",)], "scene STRING")
    assert names(retrieval.retrieve_where(metrics, path(), "all", scenes)) == {"clear", "nothing"}
    assert names(retrieval.retrieve_where(metrics, path(), "any", scenes)) == {"clear"}


def test_transition_across_block_borders(spark):
    """A scene longer than a block, with hits right at the borders, against the join form."""
    frames = spark.range(0, 9000).select(
        F.lit("long").alias("scene"), F.col("id").cast("int").alias("t"), (F.col("id") % 1024 < 1020).alias("free")
    )
    pairs = {"hit": (F.col("free"), ~F.col("free"), 3)}
    got = {r["t"] for r in temporal.transition_hits(frames, pairs).where("hit").collect()}
    want = {t for t in range(9000) if t % 1024 < 1020 and any(u % 1024 >= 1020 for u in range(t + 1, min(t + 4, 9000)))}
    assert got == want
    assert temporal.transition_hits(frames, pairs).count() == 9000


def test_persistent(spark):
    pattern = "x.xx.xxx.x"
    frames = spark.createDataFrame([("s", t, c == "x") for t, c in enumerate(pattern)], "scene STRING, t INT, b BOOLEAN")
    for at_least in (1, 2, 3):
        want = set()
        for t in range(len(pattern)):
            for start in range(max(0, t - at_least + 1), t + 1):
                if pattern[start:start + at_least] == "x" * at_least:
                    want.add(t)
        got = {r["t"] for r in temporal.persistent(frames, F.col("b"), at_least).where("persistent").collect()}
        assert got == want


# --- The seven-scene set with known answers ---------------------------------------------------------

V = 0.2
WALL_SIDE = 1.85 / 2 + V / 2 + 0.4


def place(forward, lateral, state=1, height=1.0):
    return (round((10 + forward) / V), round((10 + lateral) / V), round(height / V), state)


def steps(start, stop):
    return [start + n * V for n in range(round((stop - start) / V))]


@pytest.fixture(scope="module")
def seven(spark):
    from scene_rows import Builder

    b = Builder(spark, voxel=V)
    wall = [place(f, WALL_SIDE) for f in steps(2.0, 8.0)]
    ego = {"ego": (10, 10)}
    b.frame("tight_pass", cells=wall, speed=12, **ego)
    b.frame("slow_near", cells=wall, speed=5, **ego)
    b.frame("open_road", speed=12, **ego)
    b.frame("narrowing_corridor", cells=[place(f, s) for f in steps(2.0, 9.0) for s in (0.8, -0.8)], speed=5, **ego)
    b.frame("blocked_then_clears", 0, cells=[place(4.0, s) for s in steps(0.0, 1.2)], speed=8, **ego)
    b.frame("blocked_then_clears", 1, speed=8, **ego)
    b.frame("blocked_then_clears", 2, speed=8, **ego)
    b.frame("unknown_side", cells=[(*c[:3], -1) for c in wall], speed=12, **ego)
    b.frame("near_vehicle", boxes=[((11.5, 10, 1), "vehicle")], speed=10, **ego)
    truth = spark.createDataFrame([
        ("tight_clearance_at_speed", "tight_pass"), ("corridor_narrows_below_vehicle_width", "narrowing_corridor"),
        ("blocked_then_clears", "blocked_then_clears"), ("near_a_tracked_vehicle", "near_vehicle"),
    ], "query_id STRING, scene STRING")
    return fm.frame_metrics(b.frames, b.voxels, b.boxes, cat.needs_of(cat.CATALOGUE)), truth


def test_seven_scenes_retrieved(seven):
    metrics, _ = seven
    got = {}
    for r in retrieval.retrieve(metrics, cat.CATALOGUE).collect():
        got.setdefault((r["query_id"], r["policy"]), set()).add(r["scene"])
    assert got["tight_clearance_at_speed", "free"] == {"tight_pass"}
    assert got["tight_clearance_at_speed", "occupied"] == {"tight_pass", "unknown_side"}
    assert got["tight_clearance_at_speed", "ignored"] == {"tight_pass"}
    for policy in ("free", "occupied", "ignored"):
        assert got["corridor_narrows_below_vehicle_width", policy] == {"narrowing_corridor"}
        assert got["blocked_then_clears", policy] == {"blocked_then_clears"}
        assert got["near_a_tracked_vehicle", policy] == {"near_vehicle"}


def test_seven_scenes_report(spark, seven):
    metrics, truth = seven
    rows = {(r["query_id"], r["policy"]): r for r in ev.full_report(metrics, cat.CATALOGUE, truth).collect()}
    assert len(rows) == 10
    tight = rows["tight_clearance_at_speed", "occupied"]
    assert (tight["precision"], tight["recall"], tight["f1"], tight["undetermined"]) == (0.5, 1.0, 0.667, 1)
    assert not tight["unknown_stable"]
    assert all(r["f1"] == 1.0 for k, r in rows.items() if k != ("tight_clearance_at_speed", "occupied"))
    assert sum(not r["unknown_stable"] for (q, p), r in rows.items() if p == "free") == 1
    counts = ev.coverage(ev.query_table(spark, cat.CATALOGUE)).first()
    assert (counts["queries"], counts["occupancy_expressible"], counts["box_expressible"]) == (4, 4, 1)


def test_match_matrix(seven):
    metrics, _ = seven
    rows = {r["scene"]: r for r in retrieval.match_matrix(metrics, cat.CATALOGUE).collect()}
    assert len(rows) == 7
    assert rows["unknown_side"]["tight_clearance_at_speed__occupied"] and not rows["unknown_side"]["tight_clearance_at_speed__free"]


def test_gate_changes_no_match(spark):
    from scene_rows import Builder

    b = Builder(spark)
    for n, speed in enumerate((5.0, 9.0, 8.33)):
        b.frame(f"s{n}", cells=[(5, 2, 2)], speed=speed)
    needs = cat.needs_of([cat.TIGHT_CLEARANCE])
    found = []
    for gate in (needs.gate, None):
        m = fm.frame_metrics(b.frames, b.voxels, None, replace(needs, gate=gate))
        assert m.count() == 3
        found.append(names(retrieval.retrieve_where(m, (F.col("clearance_free") < 0.8) & (F.col("speed") > 8.33))))
    assert found == [{"s1"}, {"s1"}]


def test_query_rules():
    with pytest.raises(ValueError):
        cat.Query("a", "", scope="sometimes", predicate=lambda f: f.ego_speed() > 1)
    with pytest.raises(ValueError):
        cat.Query("a", "", scope="transition", predicate=lambda f: f.ego_speed() > 1)
    fast = lambda f: f.ego_speed() > 1
    for wrong in (
        {"scope": "any"}, {"predicate": fast, "backend": "lidar"}, {"predicate": fast, "status": "planned"},
        {"predicate": fast, "within_frames": 2}, {"predicate": fast, "before": fast},
        {"scope": "transition", "before": fast, "after": fast}, {"scope": "transition", "before": fast, "within_frames": 2},
        {"scope": "transition", "before": fast, "after": fast, "within_frames": 2, "predicate": fast},
    ):
        with pytest.raises(ValueError):
            cat.Query("a", "", **wrong)
    cat.Query("a", "", scope="transition", before=fast, after=fast, within_frames=1)
    cat.Query("a", "", scope="all", predicate=fast)
    with pytest.raises(ValueError):
        cat.Query("a", "", scope="all", predicate=lambda f: f.ego_speed() > 1, gate=lambda f: f.ego_speed() > 1)
    needs = cat.needs_of(cat.CATALOGUE)
    assert needs.gate is None and cat.needs_of([cat.TIGHT_CLEARANCE, cat.NEAR_VEHICLE]).gate is not None
    assert needs.clearance and not needs.centerline and needs.ego_width
    assert (needs.path_horizons, needs.width_horizons, needs.labels) == ((1.0,), (2.0,), ("vehicle",))


# --- Scores -----------------------------------------------------------------------------------------


def test_score_edge_cases(spark):
    queries = spark.createDataFrame([(q,) for q in ("both", "none", "extra", "missing", "miss", "third")], "query_id STRING")
    got = [("both", "a"), ("extra", "a"), ("miss", "a"), ("third", "a"), ("third", "b"), ("third", "c"), ("third", "c")]
    want = [("both", "a"), ("missing", "a"), ("miss", "b"), ("third", "a")]
    schema = "query_id STRING, scene STRING"
    scores = ev.score(spark.createDataFrame(got, schema), spark.createDataFrame(want, schema), queries)
    rows = {r["query_id"]: (r["precision"], r["recall"], r["f1"]) for r in scores.collect()}
    assert rows == {
        "both": (1.0, 1.0, 1.0), "none": (1.0, 1.0, 1.0), "extra": (0.0, 1.0, 0.0), "missing": (1.0, 0.0, 0.0),
        "miss": (0.0, 0.0, 0.0), "third": (0.333, 1.0, 0.5),
    }


def test_outcomes(spark):
    schema = "query_id STRING, scene STRING"
    rows = ev.outcomes(
        spark.createDataFrame([("q", "a"), ("q", "b")], schema), spark.createDataFrame([("q", "b"), ("q", "c")], schema)
    ).collect()
    assert {(r["scene"], r["outcome"]) for r in rows} == {("a", "fp"), ("b", "tp"), ("c", "fn")}


def test_measurement_agreement(spark):
    inf = float("inf")
    pairs = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (inf, 1.0), (inf, inf), (1.2, 1.0)], "a DOUBLE, b DOUBLE")
    r = ev.measurement_agreement(pairs, "a", "b").first()
    assert (r["both_finite"], r["both_open"], r["one_open"], r["within_tolerance"]) == (3, 1, 1, 2)
    assert r["mae"] == pytest.approx(0.4) and r["tolerance_accuracy"] == pytest.approx(2 / 3)


def test_threshold_curve(spark):
    values = spark.createDataFrame([("a", 0.2), ("b", 0.8), ("c", float("inf"))], "scene STRING, value DOUBLE")
    truth = spark.createDataFrame([("a",), ("d",)], "scene STRING")
    rows = {r["threshold"]: (r["tp"], r["fp"], r["fn"]) for r in ev.threshold_curve(values, "value", (0.1, 0.5, 1.0), truth).collect()}
    assert rows == {0.1: (0, 0, 2), 0.5: (1, 0, 1), 1.0: (1, 1, 1)}


def test_gate_is_part_of_the_condition(scenes):
    """A slow scene with a wall at 1.6 m: dropping its voxels by the gate must not make it match, alone or in a batch."""
    gated = cat.Query(id="open_at_speed", text="", predicate=lambda f: f.lateral_clearance() > 5, gate=lambda f: f.ego_speed() > 8)
    plain = cat.Query(id="open", text="", predicate=lambda f: f.lateral_clearance() > 5)
    b = scenes().frame("slow", cells=[(2, 2, 1)], speed=3.0).frame("fast", cells=[(2, 2, 1)], speed=9.0).frame("free", speed=9.0)
    for batch in ([gated], [gated, plain]):
        found = retrieval.retrieve(fm.frame_metrics(b.frames, b.voxels, None, cat.needs_of(batch)), batch).collect()
        assert {r["scene"] for r in found if r["query_id"] == "open_at_speed"} == {"free"}


def test_unknown_flags_do_not_hold(spark):
    rows = spark.createDataFrame([("a", None), ("b", None), ("b", True), ("c", True)], "scene STRING, hit BOOLEAN")
    got = {r["scene"]: (r["all"], r["any"]) for r in temporal.scope_flags(rows, {"all": ("hit", "all"), "any": ("hit", "any")}).collect()}
    assert got == {"a": (False, False), "b": (False, True), "c": (True, True)}
