"""Properties that matter at scale: no shuffle on bucketed tables, small partials, hot keys."""

import re

import pytest
from pyspark.sql import functions as F

from clearway.operators import frame_metrics as fm
from clearway.operators import inspection, obstacles, rays, retrieval, temporal
from clearway.plans import catalogue as cat
from clearway.plans.joins import with_attrs
from clearway.sources.tables import write_frame_table

NEEDS = fm.Needs(True, True, (1.0,), (2.0,))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def grid(spark, rows, hot_share=3):
    """Synthetic voxel rows of which one frame holds a third."""
    hot = F.col("id") % hot_share == 0
    voxels = spark.range(rows).select(
        F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 40).cast("string"))).alias("scene"),
        F.when(hot, F.lit(0)).otherwise((F.col("id") / 7 % 5).cast("int")).alias("t"),
        (F.col("id") * 31 % 60).cast("int").alias("i"), (F.col("id") * 17 % 24).cast("int").alias("j"),
        (F.col("id") * 13 % 6).cast("int").alias("k"), F.when(F.col("id") % 5 == 0, -1).otherwise(1).alias("state"),
    )
    frames = voxels.select("scene", "t").distinct().select(
        "scene", "t", F.lit(0.0).alias("time_s"), F.lit(0.0).alias("ex"), F.lit(0.0).alias("ey"), F.lit(0.0).alias("ez"),
        F.lit(0.0).alias("heading"), F.lit(1.0).alias("fwd_x"), F.lit(0.0).alias("fwd_y"), F.lit(9.0).alias("speed"),
        F.lit(1.85).alias("width"), F.lit(4.6).alias("length"), F.lit(1.9).alias("height"), F.lit(0.5).alias("voxel_size"),
        F.lit(-5.0).alias("ox"), F.lit(-6.0).alias("oy"), F.lit(0.0).alias("oz"), F.lit(0.25).alias("ground_height"),
    )
    return voxels, frames


@pytest.fixture(scope="module")
def bucketed(spark, tmp_path_factory):
    # Tables of this test live in its own folder.
    folder = tmp_path_factory.mktemp("warehouse")
    voxels, frames = grid(spark, 20000)
    for name, df in (("t_voxels", voxels), ("t_frames", frames)):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        df.write.mode("overwrite").option("path", f"{folder}/{name}").bucketBy(4, "scene", "t").sortBy("scene", "t").saveAsTable(name)
    yield spark.table("t_voxels"), spark.table("t_frames")
    for name in ("t_voxels", "t_frames"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_bucketed_tables_need_no_shuffle(spark, bucketed):
    voxels, frames = bucketed
    stored = voxels.join(frames.hint("merge"), ["scene", "t"])
    plan = plan_of(stored)
    assert "Exchange" not in plan
    metrics = fm.occupancy_metrics(stored, frames, NEEDS)
    assert "Exchange" not in plan_of(metrics)
    full = fm.frame_metrics(frames.hint("merge"), stored, None, NEEDS)
    assert "Exchange" not in plan_of(full)


def test_write_frame_table(spark, tmp_path):
    voxels, frames = grid(spark, 500)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS scale_test LOCATION '{tmp_path}'")
    write_frame_table(voxels, "scale_test.voxels", 4)
    write_frame_table(frames, "scale_test.frames", 4)
    table = spark.table("scale_test.voxels")
    assert table.count() == 500
    assert "Exchange" not in plan_of(table.groupBy("scene", "t").count())
    spark.sql("DROP DATABASE scale_test CASCADE")


def test_gate_and_state_reach_the_scan(spark, tmp_path):
    """With the frame columns stored on the voxels, a query's gate is a filter of the Parquet scan."""
    voxels, frames = grid(spark, 5000)
    voxels.join(frames, ["scene", "t"]).write.parquet(f"{tmp_path}/stored")
    stored = spark.read.parquet(f"{tmp_path}/stored")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = plan_of(fm.occupancy_metrics(stored, frames, cat.needs_of([cat.TIGHT_CLEARANCE])))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):plan.index("ReadSchema")]
    assert "GreaterThan(speed,8.33)" in pushed and "In(state" in pushed
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "time_s" not in read and "heading" not in read
    assert plan.count("Join") == 0


def test_partials_combine_before_the_shuffle(spark):
    voxels, frames = grid(spark, 20000)
    plan = plan_of(fm.occupancy_metrics(voxels, frames, fm.Needs(clearance=True)))
    assert plan.count("HashAggregate") >= 2 and "partial_min" in plan and "SortAggregate" not in plan


def test_hot_frame_gives_the_same_metrics(spark):
    """A frame with a third of all rows, many of them copies: joined, stored and unique input agree."""
    voxels, frames = grid(spark, 60000)
    attrs = ["ex", "ey", "fwd_x", "fwd_y", "speed", "width", "length", "height", "voxel_size", "ox", "oy", "oz", "ground_height"]
    shuffled = with_attrs(voxels, frames.hint("merge"), attrs)
    unique = obstacles.unique_cells(voxels)
    results = [
        {(r["scene"], r["t"]): r for r in fm.frame_metrics(frames, v, None, NEEDS).collect()} for v in (voxels, shuffled, unique)
    ]
    assert results[0] == results[1] == results[2] and ("hot", 0) in results[0]


def test_join_is_left_to_the_optimiser(spark):
    """No hint and no job of its own: a side is broadcast only below Spark's threshold."""
    voxels, frames = grid(spark, 1000)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in plan_of(with_attrs(voxels, frames, ["speed"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert with_attrs(with_attrs(voxels, frames, ["speed"]), frames, ["speed"]).columns == [*voxels.columns, "speed"]


def test_hot_scene_windows_split_into_blocks(spark):
    frames = spark.range(50000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 100).cast("string"))).alias("scene"),
        F.when(F.col("id") % 3 == 0, (F.col("id") / 3)).otherwise(F.col("id") / 100).cast("int").alias("t"),
        (F.col("id") * 7 % 11 < 6).alias("free"),
    ).dropDuplicates(["scene", "t"])
    plan = plan_of(temporal.transition_hits(frames, {"hit": (~F.col("free"), F.col("free"), 3)}))
    assert "hashpartitioning(scene" in plan and "_block" in plan
    window = retrieval.retrieve_transition(frames, ~F.col("free"), F.col("free"), 3)
    joined = temporal.transition_hits_by_join(frames, ~F.col("free"), F.col("free"), 3)
    assert window.exceptAll(joined).isEmpty() and joined.exceptAll(window).isEmpty()


def test_many_rays_through_one_cell(spark):
    """All rays of a hot frame start at the same cell; depth counts stay per ray."""
    rows = spark.range(3000).select(
        F.col("id").alias("ray_id"), F.lit("hot").alias("scene"), F.lit(0).alias("t"), F.lit(0).alias("si"), F.lit(0).alias("sj"),
        F.lit(0).alias("sk"), (F.col("id") % 30 + 2).cast("int").alias("di"), F.lit(0).alias("dj"), F.lit(0).alias("dk"),
    )
    voxels = spark.range(1000).select(
        F.lit("hot").alias("scene"), F.lit(0).alias("t"), (F.col("id") % 2 + 1).cast("int").alias("i"), F.lit(0).alias("j"),
        F.lit(0).alias("k"), F.lit(1).alias("state"),
    )
    got = rays.occlusion(rows, voxels).groupBy("di").agg(F.min("depth").alias("a"), F.max("depth").alias("b")).collect()
    assert all(r["a"] == r["b"] == (1 if r["di"] == 2 else 2) for r in got) and len(got) == 30


def test_needs_keep_unused_metrics_out_of_the_plan(spark):
    voxels, frames = grid(spark, 1000)
    plan = plan_of(fm.frame_metrics(frames, voxels, None, cat.needs_of([cat.TIGHT_CLEARANCE])))
    assert "station" not in plan and "hypot" not in plan.lower()


def test_unboxed_units_share_no_join_key(spark):
    """Most units without boxes: they are counted, not joined, and the answer is the same as by brute force."""
    answers = spark.range(3000).select(F.concat(F.lit("s"), F.col("id")).alias("scene"), F.lit(0).alias("t"), (F.col("id") % 5 == 0).alias("answer"))
    boxes = spark.range(30).select(
        F.concat(F.lit("s"), F.col("id")).alias("scene"), F.lit(0).alias("t"), (F.col("id") % 3).cast("double").alias("cx"), F.lit(0.0).alias("cy"),
        F.lit(0.0).alias("cz"), *[F.lit(1.0).alias(c) for c in ("sx", "sy", "sz")], F.lit(0.0).alias("yaw"), F.lit("car").alias("label"),
        F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"),
    )
    out = inspection.indistinguishable_units(answers, boxes, ["scene", "t"])
    join = plan_of(out)
    rows = {r["scene"]: (r["n_boxes"], r["group_size"], r["group_matches"]) for r in out.collect()}
    assert len(rows) == 3000 and rows["s2999"] == (0, 2970, 594) and rows["s1"] == (1, 10, 2)
    assert join.count("Join") == 1


def test_hash_aggregates_only(spark):
    from __spark_entry__ import queries

    for name in ("label_volume_ingest", "representative_frames"):
        assert "SortAggregate" not in plan_of(queries()[name](spark, "/root/testdata/sf0.001"))
