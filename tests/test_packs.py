"""Volumes in packs, and volumes in memory."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from clearway.plans import registry
from clearway.sources import label_volumes, zips

FOLDER = "/root/testdata/sf0.001"


def npz(classes, compressed=True, **masks):
    out = io.BytesIO()
    (np.savez_compressed if compressed else np.savez)(out, semantics=classes, **masks)
    return out.getvalue()


def cells(classes, mask=None):
    hidden = np.zeros(classes.shape, bool) if mask is None else mask == 0
    return sorted([(*map(int, c), -1) for c in np.argwhere(hidden)] + [(*map(int, c), 1) for c in np.argwhere(~hidden & ~np.isin(classes, [11, 12, 13, 14, 17]))])


@pytest.mark.parametrize("name", ["label_volume_files", "label_volume_source"])
def test_many_volumes_share_a_file(spark, tmp_path, monkeypatch, name):
    """A file for each volume takes a block of the disk each."""
    monkeypatch.setattr(registry, "new_shared_path", lambda _, kind: f"{tmp_path}/{kind}")
    frames = queries()[name](spark, FOLDER).select("scene", "t").distinct().count()
    found = [f for f in (tmp_path / "volumes").rglob("*") if f.is_file()]
    assert frames > 100 and 0 < len(found) < frames / 4


def volumes_of(spark, n, shape=(3, 4, 8)):
    rng = np.random.default_rng(n)
    rows, truth = [], {}
    for x in range(n):
        classes, mask = rng.integers(0, 18, shape).astype(np.uint8), rng.integers(0, 2, shape).astype(np.uint8)
        rows.append((f"s{x % 5}", f"t{x}", bytearray(npz(classes, mask_lidar=mask))))
        truth[f"s{x % 5}", f"t{x}"] = cells(classes, mask)
    return spark.createDataFrame(rows, "scene string, token string, content binary").repartition(2, "scene").sortWithinPartitions("scene", "token"), truth


def collected(rows, key="token"):
    got = {}
    for r in rows.collect():
        got.setdefault((r["scene"], r[key]), []).append((r["i"], r["j"], r["k"], r["state"]))
    return {k: sorted(v) for k, v in got.items()}


def test_packs_are_read_by_index_and_without_one(spark, tmp_path, monkeypatch):
    """Packs end at a number of volumes, are plain zip archives, and a repeated write replaces them."""
    monkeypatch.setattr(label_volumes, "PACK_VOLUMES", 7)
    volumes, truth = volumes_of(spark, 40)
    for _ in range(2):
        index = label_volumes.write_packs(volumes, f"file:{tmp_path}/packs").collect()
    names = [n for f in (tmp_path / "packs").iterdir() for n in zipfile.ZipFile(f).namelist()]
    assert len(names) == len(set(names)) == 40 and all(f.suffix == ".zip" and zipfile.ZipFile(f).testzip() is None for f in (tmp_path / "packs").iterdir())
    assert len(list((tmp_path / "packs").iterdir())) >= 6
    frames = spark.createDataFrame([(r["scene"], r["token"], r["pack"]) for r in index], "scene string, t string, gt_path string")
    assert collected(label_volumes.read_label_volumes(spark, frames, f"{tmp_path}/packs"), "t") == truth
    assert collected(label_volumes.scan_label_volumes(spark, f"{tmp_path}/packs", packed=True)) == truth
    some = label_volumes.scan_label_volumes(spark, f"{tmp_path}/packs", packed=True, scenes=["s3", "gone"])
    assert collected(some) == {k: v for k, v in truth.items() if k[0] == "s3"}
    lost = frames.withColumn("gt_path", F.concat("gt_path", F.lit("x")))
    with pytest.raises(Exception, match="is not in its pack"):
        label_volumes.read_label_volumes(spark, lost, f"{tmp_path}/packs").collect()


def test_volumes_of_any_make(spark):
    """Stored or deflated, other shapes, numbers and orders of the axes, with members that are not asked for."""
    rng = np.random.default_rng(2)
    rows, truth = [], {}
    for n, (shape, kind, order) in enumerate([((3, 4, 8), "u1", "C"), ((3, 4, 8), "i8", "C"), ((5, 3, 3), "u1", "F"), ((2, 2, 2), ">i2", "F"), ((0, 3, 4), "u1", "C"), ((3, 4, 8), "u1", "C")]):
        classes = np.asarray(rng.integers(0, 18, shape), kind, order)
        mask = np.asarray(rng.integers(0, 3, shape), (kind, "?")[n % 2], order)
        rows.append((f"s{n}", n, bytearray(npz(classes, n % 3 > 0, mask_lidar=mask, mask_camera=mask))))
        truth[f"s{n}", n] = cells(classes, mask)
    volumes = spark.createDataFrame(rows, "scene string, t int, content binary").coalesce(1)
    assert collected(label_volumes.decode_volumes(volumes), "t") == {k: v for k, v in truth.items() if v}
    without = spark.createDataFrame([("s", 0, bytearray(npz(np.zeros((2, 2, 2), np.uint8))))], volumes.schema)
    assert collected(label_volumes.decode_volumes(without, mask="none"), "t") == {("s", 0): cells(np.zeros((2, 2, 2), np.uint8))}
    with pytest.raises(Exception, match="mask_lidar"):
        label_volumes.decode_volumes(without).collect()


def test_damaged_volumes_are_errors():
    whole = npz(np.zeros((3, 4, 8), np.uint8), mask_lidar=np.ones((3, 4, 8), np.uint8))
    members = dict(zips.entries(whole))
    at = whole.index(members["semantics.npy"].data) + 20
    for content in (whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1:], whole[:100], b""):
        with pytest.raises(Exception):
            label_volumes._loaded(content, "mask_lidar")


def test_archives_are_read_as_zipfile_reads_them():
    parts = {"a": b"", "b/c.npz": b"x" * 1000, "d": bytes(range(256)) * 9}
    ours = zips.zipped({n: zips.deflated(d) if n == "d" else zips.stored(d) for n, d in parts.items()})
    with zipfile.ZipFile(io.BytesIO(ours)) as archive:
        assert archive.testzip() is None and {n: archive.read(n) for n in archive.namelist()} == parts
    theirs = io.BytesIO()
    with zipfile.ZipFile(theirs, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in parts.items():
            archive.writestr(name, data)
    for content in (ours, theirs.getvalue()):
        assert {n: zips.unpacked(m) for n, m in zips.entries(content)} == parts
    with pytest.raises(ValueError):
        list(zips.entries(theirs.getvalue() + b"more"))


def test_cells_of_volumes_are_no_rows_before_they_are_packed(spark):
    """What is packed are strips, sorted inside their task; no list of a frame's cells is built in the JVM."""
    plan = queries()["label_volume_ingest"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("MapInArrow"):]
    assert plan.count("MapInArrow") == 2 and "collect_list" not in plan and "Aggregate" not in below.split("Exchange")[0]


@pytest.mark.parametrize("size", [1, 3, 10_000])
def test_a_frame_spread_over_batches_is_one_volume(spark, size):
    """Of several strips in a cell the largest label wins; a frame whose strips have no place is a volume without cells."""
    rows = [(1, 0, 3, 5, 2, 64 + 4 * 2 + 1), (1, 0, 3, 5, 2, 64 + 7 * 2 + 1), (1, 0, 5, 5, 2, -64 + 9 * 2), (1, 0, 3, 5, 2, 64 + 2 * 2 + 1),
            (1, 1, 0, 0, 0, -64), (None, 0, 52, 23, 7, 64 + 1), (2, 0, None, 1, 1, 64 + 1), (2, 1, 1, 1, 1, None), (2, 2, 1, 1, 1, 64 + 1)]
    heads = spark.createDataFrame(rows, "scene long, t int, i int, j int, k int, label int").coalesce(1).sortWithinPartitions("scene", "t")

    class Tables:
        def strip_heads(self, *_, where):
            return heads

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        volumes = registry.packed_volumes(Tables()).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted((r["scene"] or 0, r["t"]) for r in volumes) == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]
    for r in volumes:
        with np.load(io.BytesIO(r["content"])) as arrays:
            classes, mask = arrays["semantics"], arrays["mask_lidar"]
        got = {(*map(int, c), int(classes[tuple(c)]), int(mask[tuple(c)])) for c in np.argwhere((classes != 17) | (mask != 1))}
        want = {(1, 0): {(i, 5, 2, 7, 1) if i < 11 else (i, 5, 2, 9, 0) for i in range(3, 13)}, (1, 1): {(i, 0, 0, 0, 0) for i in range(8)},
                (0, 0): {(i, 23, 7, 0, 1) for i in range(52, 60)}, (2, 2): {(i, 1, 1, 0, 1) for i in range(1, 9)}}
        assert got == want.get((r["scene"] or 0, r["t"]), set())


@pytest.mark.parametrize("cell", [(53, 0, 0), (-1, 0, 0), (0, 24, 0), (0, 0, 8)])
def test_cells_outside_the_grid_are_an_error(cell):
    import pyarrow as pa

    heads = pa.table(dict(zip("ijk", ([c] for c in cell))) | {"scene": [1], "t": [0], "label": [65]})
    with pytest.raises(ValueError, match="outside the grid"):
        list(registry.volume_rows(heads, np.zeros(1, np.int64)))
