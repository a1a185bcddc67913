"""The JSON scene index: scene -> frame token -> links, stamp, pose and label path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clearway.functions.geometry import heading_columns
from clearway.operators.linking import temporal_order
from clearway.operators.temporal import ego_speed
from clearway.sources.index_ranges import RANGE_BYTES, frame_entries

FRAME_SCHEMA = "STRUCT<prev: STRING, next: STRING, timestamp: BIGINT, ego_pose: STRUCT<translation: ARRAY<DOUBLE>>, gt_path: STRING>"
INDEX_SCHEMA = f"scene_infos MAP<STRING, MAP<STRING, {FRAME_SCHEMA}>>"

# Calibration of the ego-centric label volumes and the default vehicle.
VOXEL_SIZE = 0.4
GRID_SHAPE = (200, 200, 16)
GRID_RANGE = ((-40.0, 40.0), (-40.0, 40.0), (-1.0, 5.4))
GROUND_HEIGHT = -1.0
EGO_WIDTH = 1.85
EGO_LENGTH = 4.6
EGO_HEIGHT = 1.9


def _required(value: Column, what: str) -> Column:
    missing = F.raise_error(F.concat(F.lit(f"no {what} in frame "), F.col("token"), F.lit(" of scene "), F.col("scene")))
    return F.coalesce(value, missing)


def parse_index(documents: DataFrame) -> DataFrame:
    """One row per (scene, token); ``doc`` numbers the documents and ``pos`` is the place of the token in its document.

    A scene may be spread over documents: (doc, pos) is its file order, and the first of repeated tokens counts. ``doc``
    is (file, number), or just a number where the documents come from no file. A frame without a stamp
    or a planar position is an error as soon as these are read.
    """
    number = F.monotonically_increasing_id()
    if "doc" not in documents.columns:
        documents = documents.withColumn("doc", F.struct(F.lit("").alias("file"), number.alias("at")))
    scenes = documents.select("doc", F.explode("scene_infos").alias("scene", "tokens"))
    frames = scenes.select("scene", "doc", F.posexplode("tokens").alias("pos", "token", "f"))
    return _first_of_each(frames)


def _first_of_each(frames: DataFrame) -> DataFrame:
    """Columns of the index from (scene, doc, pos, token, f)."""
    first = frames.groupBy("scene", "token").agg(F.min_by(F.struct("doc", "pos", "f"), F.struct("doc", "pos")).alias("r"))
    frames = first.select("scene", "token", "r.doc", "r.pos", "r.f")
    return frames.select(
        "scene", "token", "doc", "pos", "f.prev", "f.next", _required(F.col("f.timestamp"), "time stamp").alias("ts_us"),
        _required(F.try_element_at("f.ego_pose.translation", F.lit(1)), "position").alias("tx"),
        _required(F.try_element_at("f.ego_pose.translation", F.lit(2)), "position").alias("ty"),
        "f.gt_path",
    )


def read_scene_index(spark: SparkSession, path: str, *, line_delimited: bool = False) -> DataFrame:
    """Read one or many index files.

    A file is one document and one task by default; line-delimited documents (say one scene per line) are split over tasks, and
    :func:`read_index_ranges` splits any file.
    """
    reader = spark.read.schema(INDEX_SCHEMA).option("multiLine", str(not line_delimited).lower())
    documents = reader.json(path)
    # Numbers grow along a file, so with its name they give one order of all documents.
    doc = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    return parse_index(documents.select("scene_infos", doc.alias("doc")))


def read_index_ranges(spark: SparkSession, path: str, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Read index files of any size and layout in byte ranges, so that one object is many tasks and no scene is one value.

    The rows of :func:`read_scene_index`, but ``pos`` is the place of a frame in its file in bytes and ``doc`` holds the file alone.
    """
    entries = frame_entries(spark, path, range_bytes)
    frames = entries.select(
        "scene", F.struct(F.col("file"), F.lit(0).cast("long").alias("at")).alias("doc"), F.col("at").alias("pos"), "token",
        F.from_json("entry", FRAME_SCHEMA).alias("f"),
    )
    return _first_of_each(frames)


def missing_scenes(requested: DataFrame, index: DataFrame) -> DataFrame:
    """Requested scene names that the index does not hold."""
    return requested.select("scene").distinct().join(index.select("scene").distinct(), "scene", "left_anti")


def require_scenes(requested: DataFrame, index: DataFrame) -> DataFrame:
    """The index rows of the requested scenes; an unknown name is an error."""
    missing = [r["scene"] for r in missing_scenes(requested, index).limit(5).collect()]
    if missing:
        raise KeyError(f"scenes not in the index, for example: {missing}")
    return index.join(requested.select("scene").distinct(), "scene", "left_semi")


def frames_from_index(index: DataFrame) -> DataFrame:
    """The frames table of ego-centric recordings: ego at the origin, heading 0, speed from the poses."""
    ordered = ego_speed(temporal_order(index))
    origin = [low + VOXEL_SIZE / 2.0 for low, _ in GRID_RANGE]
    zero = F.lit(0.0)
    return ordered.select(
        "scene", "t", "token", "gt_path", (F.col("ts_us") / F.lit(1e6)).alias("time_s"),
        zero.alias("ex"), zero.alias("ey"), zero.alias("ez"), zero.alias("heading"), *heading_columns(zero), "speed",
        F.lit(EGO_WIDTH).alias("width"), F.lit(EGO_LENGTH).alias("length"), F.lit(EGO_HEIGHT).alias("height"),
        F.lit(VOXEL_SIZE).alias("voxel_size"), F.lit(origin[0]).alias("ox"), F.lit(origin[1]).alias("oy"),
        F.lit(origin[2]).alias("oz"), F.lit(GROUND_HEIGHT).alias("ground_height"),
    )
