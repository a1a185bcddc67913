"""Table layout, scene assembly and result sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from clearway.operators.obstacles import stored_counts
from clearway.schemas import FRAME_KEY
from clearway.sources.storage import many_tasks

# Size of the row groups of voxels in layers: below the usual one, so that a file has several.
ROW_GROUP_BYTES = 16 << 20


def write_frame_table(df: DataFrame, table: str, buckets: int) -> None:
    """Save a frame, voxel or box table bucketed by (scene, t).

    Joins between such tables and every per-frame aggregate then run without a shuffle. Make voxels
    unique per cell first: a frame is then at most as large as its grid.
    """
    ordered = [*FRAME_KEY, *[c for c in ("k", "i", "j") if c in df.columns]]
    df.repartition(buckets, *FRAME_KEY).write.mode("overwrite").bucketBy(buckets, *FRAME_KEY).sortBy(*ordered).saveAsTable(table)


def write_voxel_layers(voxels: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES, dealt: bool = False) -> None:
    """Write voxels in files of whole ranges of frames, in each of which rows are ordered by layer.

    Row groups then hold few layers each, and a filter on ``k`` skips those outside by their statistics. Voxels that are ``dealt`` by
    frame already are written as they lie, which saves a shuffle of all cells and the sampling of range bounds.
    """
    ordered = ["k", *FRAME_KEY, *[c for c in ("i", "j") if c in voxels.columns]]
    rows = voxels if dealt else voxels.repartitionByRange(many_tasks(voxels.sparkSession), *FRAME_KEY)
    rows.sortWithinPartitions(*ordered).write.option("parquet.block.size", row_group_bytes).parquet(path)


def assemble_frames(frames: DataFrame, voxels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Frames next to what they hold: occupied, unknown and box counts; frames without children stay."""
    cells = stored_counts(voxels).withColumnsRenamed({"occupied": "n_occupied", "unknown": "n_unknown"})
    objects = boxes.groupBy(*FRAME_KEY).agg(F.count("*").alias("n_boxes"))
    joined = frames.join(cells, FRAME_KEY, "left").join(objects, FRAME_KEY, "left")
    return joined.fillna(0, ["n_occupied", "n_unknown", "n_boxes"])


def frame_voxels(frames: DataFrame, voxels: DataFrame) -> DataFrame:
    """The cells of the given frames, with the frame columns (grid and pose at t)."""
    return voxels.join(frames, FRAME_KEY)


def frame_boxes(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """The boxes of the given frames; a frame without boxes keeps one row with NULL box columns."""
    return frames.join(boxes, FRAME_KEY, "left")


# The file in a report's folder that names the version to read.
CURRENT = "_CURRENT"


def write_report(report: DataFrame, path: str, fmt: str = "json") -> None:
    """Write one record per report row, whole or not at all.

    The rows go to a new folder below ``path``; once they are there, one rename of a small file makes it the report. Until then, and if the write
    fails, readers keep the report before. That one is left for readers that have begun; older ones go.
    """
    version = f"version-{uuid.uuid4().hex}"
    report.write.format(fmt).save(f"{path}/{version}")
    spark = report.sparkSession
    files = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    folder = files.Path(path)
    store = folder.getFileSystem(conf)
    before = current_version(spark, path)
    note = files.Path(folder, f"_{version}")
    out = store.create(note)
    out.write(bytearray(version.encode()))
    out.close()
    replace = spark.sparkContext._gateway.new_array(getattr(files, "Options$Rename"), 1)
    replace[0] = getattr(files, "Options$Rename").OVERWRITE
    files.FileContext.getFileContext(store.getUri(), conf).rename(
        store.makeQualified(note), store.makeQualified(files.Path(folder, CURRENT)), replace)
    for status in store.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("version-") and name not in (version, before):
            store.delete(status.getPath(), True)


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder of the report at ``path`` that is to be read; None if none was ever finished."""
    files = spark._jvm.org.apache.hadoop.fs
    note = files.Path(files.Path(path), CURRENT)
    store = note.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(note):
        return None
    with_close = store.open(note)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(with_close, "UTF-8")
    finally:
        with_close.close()


def replace_queries(report: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write the rows of some queries into a report that is partitioned by query; those of other queries stay as they are."""
    writer = report.write.partitionBy("query_id").format(fmt).mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").save(path)


def write_sorted(rows: DataFrame, path: str, order: list[str], fmt: str = "json") -> None:
    """Write rows in global order (range-partitioned), for example the names of a retrieved set."""
    rows.sort(*order).write.mode("overwrite").format(fmt).save(path)


def read_report(spark: SparkSession, path: str, schema, fmt: str = "json") -> DataFrame:
    """The finished report that ``write_report`` left at ``path``."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no finished report at {path}")
    return spark.read.schema(schema).format(fmt).load(f"{path}/{version}")
