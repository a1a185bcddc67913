"""Height band as a range of layers: exact bounds, pushed to the scan, fewer row groups read."""

import random

import pytest
from pyspark.sql import functions as F

from clearway import schemas
from clearway.functions import geometry as geo
from clearway.operators import obstacles
from clearway.sources import tables


def test_layers_are_those_of_the_comparison():
    """Random grids, and grids in which a layer lies on a limit but for rounding."""
    rng = random.Random(2)
    grids = [(rng.uniform(-3, 3), rng.uniform(0.05, 1), rng.uniform(-2, 2), rng.uniform(0, 4)) for _ in range(500)]
    grids += [(-0.8, 0.4, -0.8 + n * 0.4, m * 0.1) for n in range(8) for m in range(30)] + [(0.0, 0.1, 0.3, 0.0), (0.0, 0.1, 0.30000000000000004, 0.1)]
    for origin, size, ground, height in grids:
        low, high = geo.band_layers(origin, size, ground, height)
        reach = range(low - 50, max(low, high) + 50)
        want = [k for k in reach if ground < origin + k * size <= ground + height]
        assert want == list(range(low, high + 1))
        assert geo.band_layers(origin, size, ground, None) == (low, None)
    for grid in ((0.0, 0.0, 0.0, 1.0), (0.0, float("nan"), 0.0, 1.0), (float("inf"), 1.0, 0.0, 1.0)):
        with pytest.raises(ValueError):
            geo.band_layers(*grid)


def scanned_rows(df):
    """Rows that the file scan of a query without shuffles hands on, hence those of the row groups it reads."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    scan = execution.executedPlan().collectLeaves().head()
    return scan.metrics().apply("numOutputRows").value()


def test_row_groups_outside_the_band_are_skipped(spark, tmp_path):
    cells = spark.range(2_000_000).select(
        F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("scene"), (F.col("id") % 3).cast("int").alias("t"),
        F.hash("id").alias("i"), F.hash("id", F.lit(1)).alias("j"), (F.xxhash64("id") % 16 + 16).cast("int").alias("k"), F.lit(1).alias("state"))
    voxels = spark.createDataFrame([], schemas.VOXELS).unionByName(cells.withColumn("k", F.pmod("k", F.lit(16)).cast("int")))
    path = str(tmp_path / "layers")
    tables.write_voxel_layers(voxels, path, row_group_bytes=200_000)
    stored = spark.read.parquet(path)
    assert stored.count() == 2_000_000
    band = obstacles.band_voxels(stored, geo.band_layers(-1.0, 0.4, 0.0, 0.9))
    plan = band._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,3)" in plan and "LessThanOrEqual(k,4)" in plan
    kept = stored.where("k IN (3, 4)").count()
    assert band.count() == kept
    assert kept <= scanned_rows(band.select("i", "j", "k")) < 0.5 * 2_000_000
