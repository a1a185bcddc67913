"""Index files in byte ranges against the plain reader and the JSON library."""

import json
import random

import pytest
from pyspark.sql import functions as F

from clearway.sources import index_ranges, scene_index

ODD = ['a', 'a"b', 'back\\slash', '\\"', '{"x": [', '}]:,', 'ü€😀', ' spaced : key ', 'end\\\\', '"', '\\', "n\n\t"]


def frame(n, odd=""):
    return {
        "prev": odd or None, "next": f"t{n}", "timestamp": n, "camera_sensor": {"CAM": {"k": {"deep": [[1, {"x": odd}]]}}},
        "ego_pose": {"translation": [n, 0.5, 1e3], "rotation": [1, 0, 0, 0]}, "gt_path": f"g/{odd}/{n}",
    }


def odd_index(rng):
    scenes = {f"{rng.choice(ODD)}{n}": {f"{rng.choice(ODD)}{m}": frame(m, rng.choice(ODD)) for m in range(rng.randrange(5))} for n in range(4)}
    return {"before": {"x": {"y": {"z": {"timestamp": 1}}}, "s": [{"a": {"b": 1}}, "scene_infos"]}, "scene_infos": scenes, "train_split": ["{", '"'],
            "after": {"s": {"t": {"u": 1}}}}


def entries_of(index):
    return [(s, t, f) for s, tokens in index["scene_infos"].items() for t, f in tokens.items()]


@pytest.mark.parametrize("size", [1, 7, 64])
def test_any_cut_gives_the_same_entries(spark, tmp_path, size):
    """Ranges of one byte cut through every string, escape and character."""
    rng = random.Random(size)
    index = odd_index(rng) if size > 1 else {"scene_infos": {'s"': {"\\": frame(1, '\\"'), "é": frame(2, "\\")}}}
    text = json.dumps(index, indent=rng.choice([None, 1]), ensure_ascii=size == 7)
    (tmp_path / "i.json").write_text(text, encoding="utf-8")
    rows = index_ranges.frame_entries(spark, str(tmp_path / "i.json"), size).collect()
    got = [(r["scene"], r["token"], json.loads(r["entry"])) for r in sorted(rows, key=lambda r: r["at"])]
    assert got == entries_of(index)


def test_many_documents_and_plain_values(spark, tmp_path):
    first, second = ({"scene_infos": {"s": {"a": frame(1), "b": None, "c": frame(3)}, "none": None, "empty": {}}}, {"scene_infos": {"s": {"d": frame(4), "e": 5}}})
    (tmp_path / "i.json").write_text(json.dumps(first) + "\n" + json.dumps(second) + "\n")
    (tmp_path / "j.json").write_text("")
    for size in (16, 1 << 20):
        rows = sorted(index_ranges.frame_entries(spark, str(tmp_path), size).collect(), key=lambda r: r["at"])
        assert [(r["scene"], r["token"], r["entry"] == "null") for r in rows] == [
            ("s", "a", False), ("s", "b", True), ("s", "c", False), ("s", "d", False), ("s", "e", True)]
    with pytest.raises(Exception, match="in frame b of scene s"):
        scene_index.read_index_ranges(spark, str(tmp_path)).collect()


def test_one_object_is_read_by_many_tasks(spark, tmp_path):
    """An index of 100 000 frames in one object on one line, one scene holding half of them."""
    scenes = {f"s{n}": {f"{n}-{m}": frame(m) for m in range(50_000 if n == 0 else 500)} for n in range(101)}
    (tmp_path / "i.json").write_text(json.dumps({"scene_infos": scenes}))
    size = 1 << 20
    entries = index_ranges.frame_entries(spark, str(tmp_path / "i.json"), size).withColumn("task", F.spark_partition_id())
    seen = entries.groupBy("task").count().collect()
    assert len(seen) > 3 and sum(r["count"] for r in seen) == 100_000
    by_range = scene_index.read_index_ranges(spark, str(tmp_path / "i.json"), range_bytes=size)
    plain = scene_index.read_scene_index(spark, str(tmp_path / "i.json"))
    a, b = (d.drop("doc", "pos") for d in (by_range, plain))
    assert a.count() == 100_000 and a.exceptAll(b).isEmpty()
    order = {r["token"]: r["pos"] for r in by_range.where("scene = 's7'").collect()}
    assert sorted(order, key=order.get) == [f"7-{m}" for m in range(500)]
