import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearway.functions import geometry as geo
from clearway.functions.occupancy import class_state, masked_class_state
from clearway.operators import frame_metrics as fm
from clearway.operators import obstacles, retrieval
from clearway.plans import catalogue as cat
from clearway.sources import label_volumes, scene_index, tables

SHAPE = (200, 200, 16)


@pytest.fixture(scope="module")
def release(tmp_path_factory):
    """Two scenes as an index document and compressed label volumes."""
    root = tmp_path_factory.mktemp("release")
    infos = {"scene-a": {}, "scene-b": {}}
    truth = {}
    rng = np.random.default_rng(5)
    for scene, count in (("scene-a", 3), ("scene-b", 1)):
        for n in range(count):
            token = f"{scene}-{n}"
            classes = np.full(SHAPE, 17, dtype=np.uint8)
            lidar, camera = np.ones(SHAPE, dtype=np.uint8), np.ones(SHAPE, dtype=np.uint8)
            at = tuple(rng.integers(0, m, 300) for m in SHAPE)
            classes[at] = rng.integers(0, 18, 300)
            lidar[tuple(rng.integers(0, m, 50) for m in SHAPE)] = 0
            camera[tuple(rng.integers(0, m, 70) for m in SHAPE)] = 0
            path = f"gts/{scene}/{token}/labels.npz"
            (root / path).parent.mkdir(parents=True)
            np.savez_compressed(root / path, semantics=classes, mask_lidar=lidar, mask_camera=camera)
            truth[scene, n] = (classes, lidar, camera)
            infos[scene][token] = {
                "prev": f"{scene}-{n - 1}" if n else None, "next": f"{scene}-{n + 1}" if n + 1 < count else "EOF",
                "timestamp": 1_000_000 + 500_000 * n, "ego_pose": {"translation": [2.0 * n, 0.0, 0.0], "rotation": [1, 0, 0, 0]},
                "gt_path": path, "camera_sensor": {},
            }
    (root / "annotations.json").write_text(json.dumps({"train_split": [], "scene_infos": infos}, indent=1))
    return root, truth


def test_index_and_frames(spark, release):
    root, _ = release
    index = scene_index.read_scene_index(spark, f"{root}/annotations.json")
    assert index.count() == 4
    frames = {(r["scene"], r["t"]): r for r in scene_index.frames_from_index(index).collect()}
    assert [frames["scene-a", t]["token"] for t in range(3)] == ["scene-a-0", "scene-a-1", "scene-a-2"]
    assert frames["scene-a", 2]["speed"] == 4.0 and frames["scene-b", 0]["speed"] == 0.0
    assert frames["scene-a", 1]["time_s"] == 1.5 and frames["scene-a", 0]["ground_height"] == -1.0
    assert frames["scene-a", 0]["ox"] == pytest.approx(-39.8) and frames["scene-a", 0]["oz"] == pytest.approx(-0.8)


def test_requested_scenes(spark, release):
    root, _ = release
    index = scene_index.read_scene_index(spark, f"{root}/annotations.json")
    known = spark.createDataFrame([("scene-b",)], "scene STRING")
    assert scene_index.require_scenes(known, index).count() == 1
    with pytest.raises(KeyError):
        scene_index.require_scenes(spark.createDataFrame([("scene-b",), ("scene-z",)], "scene STRING"), index)


@pytest.mark.parametrize("mask", ["none", "lidar", "camera"])
def test_label_volumes(spark, release, mask):
    root, truth = release
    frames = scene_index.frames_from_index(scene_index.read_scene_index(spark, f"{root}/annotations.json"))
    voxels = label_volumes.read_label_volumes(spark, frames, f"{root}", mask=mask)
    got = {(r["scene"], r["t"], r["i"], r["j"], r["k"]): r["state"] for r in voxels.collect()}
    want = {}
    for (scene, t), (classes, lidar, camera) in truth.items():
        hidden = {"lidar": lidar == 0, "camera": camera == 0}.get(mask, np.zeros(SHAPE, bool))
        for cell in np.argwhere(hidden):
            want[(scene, t, *map(int, cell))] = -1
        for cell in np.argwhere(~hidden & ~np.isin(classes, [11, 12, 13, 14, 17])):
            want[(scene, t, *map(int, cell))] = 1
    assert got == want


def test_real_layout_end_to_end(spark, release):
    """Index and volumes to retrieval, with the frame columns stored on the voxels."""
    root, _ = release
    frames = scene_index.frames_from_index(scene_index.read_scene_index(spark, f"{root}/annotations.json"))
    attrs = ["ex", "ey", "fwd_x", "fwd_y", "speed", "width", "length", "height", "voxel_size", "ox", "oy", "oz", "ground_height"]
    stored = label_volumes.read_label_volumes(spark, frames, f"{root}", mask="lidar", attrs=attrs)
    plain = label_volumes.read_label_volumes(spark, frames, f"{root}", mask="lidar")
    chosen = [q for q in cat.CATALOGUE if q.is_occupancy]
    results = [
        {tuple(r) for r in retrieval.retrieve(fm.frame_metrics(frames, v, None, cat.needs_of(chosen)), chosen).collect()}
        for v in (stored, plain)
    ]
    assert results[0] == results[1]


def test_line_delimited_index(spark, tmp_path):
    lines = [
        {"scene_infos": {s: {f"{s}{n}": {"prev": None, "next": None, "timestamp": n, "ego_pose": {"translation": [1, 2, 3]}, "gt_path": "x"}
                             for n in (2, 0, 1)}}} for s in "ab"
    ]
    (tmp_path / "index.json").write_text("\n".join(json.dumps(x) for x in lines))
    rows = scene_index.read_scene_index(spark, str(tmp_path / "index.json"), line_delimited=True).collect()
    assert {(r["token"], r["pos"]) for r in rows} == {(f"{s}{n}", p) for s in "ab" for p, n in enumerate((2, 0, 1))}


def document(**scenes):
    return {"scene_infos": {s: {t: {"prev": p, "next": n, "timestamp": ts, "ego_pose": {"translation": at}, "gt_path": "x"} for t, p, n, ts, at in rows} for s, rows in scenes.items()}}


def test_scene_spread_over_documents(spark, tmp_path):
    """Positions restart in every document: the head is the first one in file order, repeated tokens count once."""
    first = document(s=[("a", None, "b", 5, [0, 0, 0]), ("b", "a", "c", 4, [1, 0, 0])])
    second = document(s=[("c", "b", None, 3, [2, 0, 0]), ("x", None, None, 9, [0, 0, 0]), ("a", None, "x", 5, [9, 9, 9])])
    (tmp_path / "index.json").write_text("\n".join(json.dumps(x) for x in (first, second)))
    index = scene_index.read_scene_index(spark, str(tmp_path / "index.json"), line_delimited=True)
    assert sorted(r["token"] for r in index.collect()) == ["a", "b", "c", "x"]
    from clearway.operators.linking import temporal_order

    assert {r["token"]: r["t"] for r in temporal_order(index).collect()} == {"a": 0, "b": 1, "c": 2}


@pytest.mark.parametrize("stamp,at", [(None, [0, 0, 0]), (1, [0, None, 0]), (1, [0]), (1, None)])
def test_missing_pose_is_an_error(spark, tmp_path, stamp, at):
    (tmp_path / "index.json").write_text(json.dumps(document(s=[("a", None, None, stamp, at)])))
    index = scene_index.read_scene_index(spark, str(tmp_path / "index.json"))
    assert index.select("scene").distinct().count() == 1
    with pytest.raises(Exception, match="in frame a of scene s"):
        scene_index.frames_from_index(index).collect()


def test_missing_volume_is_an_error(spark, release):
    root, _ = release
    frames = scene_index.frames_from_index(scene_index.read_scene_index(spark, f"{root}/annotations.json"))
    wrong = frames.withColumn("gt_path", F.when(F.col("t") == 1, "gts/scene-a/none/labels.npz").otherwise(F.col("gt_path")))
    with pytest.raises(Exception, match="gts/scene-a/none/labels.npz"):
        label_volumes.read_label_volumes(spark, wrong, f"{root}").collect()
    without = frames.withColumn("gt_path", F.when(F.col("t") > 0, F.col("gt_path")))
    with pytest.raises(Exception, match="no label volume"):
        label_volumes.read_label_volumes(spark, without, f"{root}").collect()


def test_only_named_files_are_opened(spark, release, tmp_path):
    """Nothing is listed and no content travels; a file that frames share is opened once per task, an unreadable one beside it never."""
    root, truth = release
    frames = scene_index.frames_from_index(scene_index.read_scene_index(spark, f"{root}/annotations.json")).where("scene = 'scene-b'")
    voxels = label_volumes.read_label_volumes(spark, frames, f"{root}/", mask="none")
    assert voxels.inputFiles() == [f for f in voxels.inputFiles() if f.endswith(".json")]
    assert voxels.select("scene").distinct().count() == 1
    assert label_volumes.read_label_volumes(spark, frames.limit(0), f"{root}").collect() == []
    plan = voxels._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange")
    shared = frames.crossJoin(spark.range(40).select(F.col("id").cast("int").alias("n"))).withColumn("t", F.col("n"))
    rows = label_volumes.read_label_volumes(spark, shared, f"{root}", mask="none", tasks=5)
    counts = {r["t"]: r["count"] for r in rows.groupBy("t").count().collect()}
    assert set(counts) == set(range(40)) and set(counts.values()) == {voxels.count()}


def test_one_open_per_file_and_only_the_members_asked_for(release, tmp_path, monkeypatch):
    """The worker function itself, with a store that counts: one open for rows of one file, no read of the other mask."""
    root, truth = release
    store, base = label_volumes.open_store(f"file:{root}/gts")
    opened, members = [], []

    class Counting:
        def open_input_file(self, path):
            opened.append(path)
            return store.open_input_file(path)

        def get_file_info(self, selector):
            return store.get_file_info(selector)

    real = np.lib.npyio.NpzFile.__getitem__
    monkeypatch.setattr(np.lib.npyio.NpzFile, "__getitem__", lambda self, key: members.append(key) or real(self, key))
    monkeypatch.setattr(label_volumes, "open_store", lambda _: (Counting(), base))
    reader = label_volumes.LabelVolumeReader({"path": "x", "mask": "camera"})
    list(reader.pushFilters([label_volumes.In(("scene",), ("scene-a", "gone"))]))
    shares = reader.partitions()
    assert [s.scenes for s in shares] == [("gone",), ("scene-a",)]
    assert sum(len(list(reader.read(s))) for s in shares) == 3
    assert len(opened) == len(set(opened)) == 3 and set(members) == {"semantics", "mask_camera"}


def test_volumes_as_a_data_source(spark, release):
    root, truth = release
    every = label_volumes.scan_label_volumes(spark, f"{root}/gts", mask="lidar")
    frames = scene_index.frames_from_index(scene_index.read_scene_index(spark, f"{root}/annotations.json"))
    by_index = label_volumes.read_label_volumes(spark, frames, f"{root}", mask="lidar", attrs=["token"]).drop("t").select(*every.columns)
    assert every.exceptAll(by_index).isEmpty() and by_index.exceptAll(every).isEmpty()
    some = label_volumes.scan_label_volumes(spark, f"{root}/gts", mask="none", scenes=["scene-b", "scene-z"])
    assert {r["scene"] for r in some.select("scene").distinct().collect()} == {"scene-b"}
    # The scene filter is the reader's: one partition per scene asked for, and no filter on the scene above the scan.
    assert some.rdd.getNumPartitions() == 2 and every.rdd.getNumPartitions() == 2
    assert "scene-z" not in some._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    assert label_volumes.scan_label_volumes(spark, f"{root}/gts", scenes=[]).count() == 0


def test_folder_without_its_volume_is_an_error(spark, release, tmp_path):
    (tmp_path / "s" / "a").mkdir(parents=True)
    with pytest.raises(Exception, match="labels.npz"):
        label_volumes.scan_label_volumes(spark, str(tmp_path)).collect()


def test_volumes_written_to_shared_storage(spark, release, tmp_path):
    root, truth = release
    frames = scene_index.frames_from_index(scene_index.read_scene_index(spark, f"{root}/annotations.json"))
    rows = [(r["gt_path"], bytearray((root / r["gt_path"]).read_bytes())) for r in frames.collect()]
    volumes = spark.createDataFrame(rows, "gt_path STRING, content BINARY")
    for _ in range(2):
        assert sum(r["written"] for r in label_volumes.write_volumes(volumes, f"{tmp_path}/copy").collect()) == len(rows)
    copied, own = (label_volumes.read_label_volumes(spark, frames, f"{r}") for r in (tmp_path / "copy", root))
    assert copied.exceptAll(own).isEmpty() and own.exceptAll(copied).isEmpty()


def test_class_states(spark):
    rows = spark.createDataFrame([(17, 1, 1), (11, 1, 1), (4, 1, 0), (4, 0, 1)], "cls INT, l INT, c INT")
    out = rows.select(
        class_state(F.col("cls")).alias("dense"), masked_class_state(F.col("cls"), F.col("l"), F.col("c")).alias("lidar"),
        masked_class_state(F.col("cls"), F.col("l"), F.col("c"), "camera").alias("camera"),
        masked_class_state(F.col("cls"), F.col("l"), F.col("c"), "none").alias("none"),
    ).collect()
    assert [tuple(r) for r in out] == [(0, 0, 0, 0), (0, 0, 0, 0), (1, 1, -1, 1), (1, -1, 1, 1)]


def test_half_even_cells(spark):
    rows = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (1.2,)], "x DOUBLE")
    out = rows.select(geo.world_to_voxel(F.col("x"), F.lit(0.0), F.lit(1.0)).alias("i")).collect()
    assert [r["i"] for r in out] == [0, 2, 2, 0, 1]
    bounds = geo.grid_bounds((200, 200, 16), (-39.8, -39.8, -0.8), 0.4)
    assert bounds == [pytest.approx((-40, 40)), pytest.approx((-40, 40)), pytest.approx((-1, 5.4))]


def test_cell_counts_and_assembly(scenes):
    b = scenes().frame("a", 0, cells=[(1, 1, 1), (1, 1, 2, -1)], boxes=[((0, 0, 0), "x")]).frame("a", 1)
    counts = {r["t"]: (r["occupied"], r["unknown"], r["free"]) for r in obstacles.cell_counts(b.voxels, b.frames, 64000).collect()}
    assert counts == {0: (1, 1, 63998), 1: (0, 0, 64000)}
    rows = {r["t"]: (r["n_occupied"], r["n_unknown"], r["n_boxes"]) for r in tables.assemble_frames(b.frames, b.voxels, b.boxes).collect()}
    assert rows == {0: (1, 1, 1), 1: (0, 0, 0)}
    assert obstacles.scene_totals(b.frames).first().asDict() == {"scenes": 1, "frames": 2}
    assert tables.frame_boxes(b.frames, b.boxes).count() == 2


def test_supported_voxels(spark, scenes):
    import random

    rng = random.Random(1)
    cells = {(rng.randrange(28, 70), rng.randrange(6), rng.randrange(5)) for _ in range(500)} | {(0, 0, 0), (31, 3, 3), (32, 3, 3)}
    b = scenes().frame("s", cells=[*cells, *list(cells)[:50]])
    for radius, least in ((1, 1), (1, 4), (2, 9)):
        want = {}
        for c in cells:
            n = sum(1 for d in cells if d != c and all(abs(x - y) <= radius for x, y in zip(c, d)))
            if n >= least:
                want[c] = n
        got = obstacles.supported_voxels(b.voxels, radius=radius, min_neighbours=least).collect()
        assert {(r["i"], r["j"], r["k"]): r["neighbours"] for r in got} == want


def test_pillars(scenes):
    b = scenes().frame("s", cells=[(5, 3, 1), (5, 3, 2, -1), (5, 4, 2, -1), (5, 5, 0), (5, 6, 9)])
    got = {(r["i"], r["j"]): (r["occupied"], r["unknown"]) for r in obstacles.pillars(b.voxels, b.frames).collect()}
    assert got == {(5, 3): (True, True), (5, 4): (False, True)}
    assert obstacles.in_grid_only(b.voxels, (6, 5, 3)).count() == 3


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("q", "b"), ("q", "a"), ("p", "z")], "query_id STRING, scene STRING")
    tables.write_report(rows, str(tmp_path / "report"), "parquet")
    assert tables.read_report(spark, str(tmp_path / "report"), rows.schema, "parquet").count() == 3
    tables.write_sorted(rows, str(tmp_path / "names"), ["query_id", "scene"])
    lines = [x for p in sorted((tmp_path / "names").glob("*.json")) for x in p.read_text().split()]
    assert [json.loads(x)["scene"] for x in lines] == ["z", "a", "b"]


def test_a_failing_report_leaves_the_one_before(spark, tmp_path):
    path = str(tmp_path / "report")
    first = spark.range(5).selectExpr("id", "id * 2 as score")
    with pytest.raises(FileNotFoundError):
        tables.read_report(spark, path, first.schema)
    failing = spark.range(100).repartition(4).selectExpr("id", "CASE WHEN id = 77 THEN raise_error('no score') ELSE id END AS score").select("id", F.col("score").cast("long"))
    with pytest.raises(Exception, match="no score"):
        tables.write_report(failing, path)
    with pytest.raises(FileNotFoundError):
        tables.read_report(spark, path, first.schema)
    tables.write_report(first, path)
    reader = tables.read_report(spark, path, first.schema)
    with pytest.raises(Exception, match="no score"):
        tables.write_report(failing, path)
    assert sorted(map(tuple, tables.read_report(spark, path, first.schema).collect())) == [(n, 2 * n) for n in range(5)]
    # A reader that began before a new report is published reads the old one to its end.
    tables.write_report(first.where("id > 2"), path)
    assert reader.count() == 5 and tables.read_report(spark, path, first.schema).count() == 2
    tables.write_report(first.where("id > 3"), path)
    kept = [f.name for f in (tmp_path / "report").iterdir() if f.name.startswith("version-")]
    assert len(kept) == 2 and tables.read_report(spark, path, first.schema).count() == 1


def test_single_queries_are_replaced(spark, tmp_path):
    path = str(tmp_path / "by_query")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "query_id string, score int")
    tables.replace_queries(rows, path)
    tables.replace_queries(spark.createDataFrame([("a", 9)], "query_id string, score int"), path)
    assert sorted((r.query_id, r.score) for r in spark.read.schema(rows.schema).parquet(path).collect()) == [("a", 9), ("b", 3), ("c", 4)]
