"""Obstacle rows, the top-down pillar map, cell counts and the lone-voxel filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clearway.functions import geometry as geo
from clearway.functions.occupancy import OCCUPIED, POLICY_OCCUPIED, UNKNOWN, blocks
from clearway.plans.joins import with_attrs
from clearway.schemas import FRAME_ATTRS, FRAME_KEY


# Consecutive cells along i that share one BIGINT mask: cell i is bit i % 64 of segment i / 64.
SEGMENT_BITS = 6
SEGMENT_CELLS = 1 << SEGMENT_BITS
SEGMENT_KEY = ["scene", "t", "j", "k", "segment"]


def segment_of(i: Column) -> Column:
    return F.shiftright(i, SEGMENT_BITS)


def place_in_segment(i: Column) -> Column:
    return i.bitwiseAND(F.lit(SEGMENT_CELLS - 1))


def bit_at(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def cell_masks(voxels: DataFrame, attrs: list[str] = []) -> DataFrame:
    """The voxel table as bit masks: per row segment, which cells are ``occupied`` and which ``unknown``.

    ``attrs`` names columns to keep that are constant per frame.
    An OCCUPIED observation wins over an UNKNOWN one, and repeated cells set the same bit, so this also
    removes duplicates. Neighbouring cells merge map-side: far fewer rows are shuffled than cells.
    """
    bit = bit_at(place_in_segment(F.col("i")))
    keyed = voxels.withColumn("segment", segment_of(F.col("i")))
    masks = keyed.groupBy(*SEGMENT_KEY).agg(*[
        F.coalesce(F.bit_or(F.when(F.col("state") == s, bit)), F.lit(0)).alias(n)
        for n, s in (("occupied", OCCUPIED), ("unknown", UNKNOWN))
    ], *[F.max(a).alias(a) for a in attrs])
    return masks.withColumn("unknown", F.col("unknown").bitwiseAND(F.bitwise_not("occupied")))


def unique_cells(voxels: DataFrame, attrs: list[str] = []) -> DataFrame:
    """One row per cell; an OCCUPIED observation wins over an UNKNOWN one. ``attrs`` names columns to keep that are constant per frame."""
    place = F.col("place")
    cells = cell_masks(voxels, attrs).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(SEGMENT_CELLS - 1))))
    occupied = F.getbit("occupied", place) == 1
    return cells.where(occupied | (F.getbit("unknown", place) == 1)).select(
        "scene", "t", (F.col("segment") * SEGMENT_CELLS + place).alias("i"), "j", "k",
        F.when(occupied, OCCUPIED).otherwise(UNKNOWN).alias("state"), *attrs,
    )


def obstacle_centers(
    voxels: DataFrame, frames: DataFrame, *, policy: str = POLICY_OCCUPIED, max_height: str | float | None = "height"
) -> DataFrame:
    """Obstacle rows above the ground with world coordinates x, y, z and frame attributes.

    ``max_height`` caps the height above ground: a frame column (the ego height by default), metres or None.
    ``policy='occupied'`` keeps UNKNOWN rows too, so one pass can serve both readings through ``state``.
    """
    rows = with_attrs(voxels.where(blocks(F.col("state"), policy)), frames, FRAME_ATTRS)
    z = geo.voxel_to_world(F.col("k"), F.col("oz"), F.col("voxel_size"))
    cap = F.col(max_height) if isinstance(max_height, str) else None if max_height is None else F.lit(float(max_height))
    return (
        rows.withColumn("z", z)
        .where(geo.in_height_band(F.col("z"), F.col("ground_height"), cap))
        .withColumn("x", geo.voxel_to_world(F.col("i"), F.col("ox"), F.col("voxel_size")))
        .withColumn("y", geo.voxel_to_world(F.col("j"), F.col("oy"), F.col("voxel_size")))
    )


def band_voxels(voxels: DataFrame, layers: tuple[int, int | None]) -> DataFrame:
    """The voxels of some layers, as a plain comparison of the stored index, which reaches the scan.

    For frames of one grid, ``geometry.band_layers`` gives the layers that the height band keeps; what reads obstacles gives the same for
    these voxels as for all. Frames whose grid or vehicle differ need the widest of their ranges.
    """
    low, high = layers
    kept = voxels.where(F.col("k") >= low)
    return kept if high is None else kept.where(F.col("k") <= high)


def ego_obstacles(voxels: DataFrame, frames: DataFrame, *, policy: str = POLICY_OCCUPIED) -> DataFrame:
    """Obstacle rows in the ego frame: ``fwd`` ahead, ``lat`` to the left, ``solid`` if OCCUPIED."""
    return (
        obstacle_centers(voxels, frames, policy=policy)
        .withColumn("fwd", geo.forward_of(F.col("x"), F.col("y")))
        .withColumn("lat", geo.lateral_of(F.col("x"), F.col("y")))
        .withColumn("solid", F.col("state") == OCCUPIED)
    )


def pillars(voxels: DataFrame, frames: DataFrame) -> DataFrame:
    """Top-down map: per (scene, t, i, j), whether the ego height band holds an occupied / unknown voxel.

    ``voxels`` must be unique per cell for ``unknown`` to be right. Every planar metric gives the same
    answer on pillars as on voxels; see :func:`pillar_voxels`.
    """
    return obstacle_centers(voxels, frames).groupBy(*FRAME_KEY, "i", "j").agg(
        F.max(F.col("state") == OCCUPIED).alias("occupied"),
        F.max(F.col("state") == UNKNOWN).alias("unknown"),
    )


def pillar_voxels(voxels: DataFrame, frames: DataFrame, attrs: list[str] = []) -> DataFrame:
    """The voxel table reduced to one in-band voxel per pillar, usable wherever voxels are. ``attrs`` names columns to keep that are constant per frame."""
    return obstacle_centers(voxels, frames).groupBy(*FRAME_KEY, "i", "j").agg(
        F.min("k").alias("k"), F.max("state").alias("state"), *[F.max(a).alias(a) for a in attrs]
    )


def stored_counts(voxels: DataFrame) -> DataFrame:
    """Occupied and unknown cells of the frames that store any; repeated cells count once."""
    return cell_masks(voxels).groupBy(*FRAME_KEY).agg(*[F.sum(F.bit_count(c)).alias(c) for c in ("occupied", "unknown")])


def cell_counts(voxels: DataFrame, frames: DataFrame, volume: int) -> DataFrame:
    """Occupied / unknown / free cells per frame; free is what the sparse table does not store.

    Frames without any stored cell are wholly free.
    """
    stored = stored_counts(voxels)
    counts = frames.select(*FRAME_KEY).join(stored, FRAME_KEY, "left").fillna(0, ["occupied", "unknown"])
    return counts.withColumn("free", F.lit(volume) - F.col("occupied") - F.col("unknown"))


def scene_totals(frames: DataFrame) -> DataFrame:
    """Number of scenes and of frames."""
    per_scene = frames.groupBy("scene").count()
    return per_scene.agg(F.count("*").alias("scenes"), F.sum("count").alias("frames"))


def in_grid_only(voxels: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Drop rows whose index lies outside the grid."""
    return voxels.where(geo.in_grid(F.col("i"), F.col("j"), F.col("k"), shape))


# Cells of one row along i packed into a bit mask; with margins on both sides it fits a BIGINT.
MASK_CELLS = 32
MASK_MARGIN = 15


def row_masks(voxels: DataFrame, radius: int) -> DataFrame:
    """Segments of ``MASK_CELLS`` cells along i as bit masks, per (scene, t, state, j, k, segment).

    Bit ``MASK_MARGIN + i % MASK_CELLS`` stands for cell i. A cell within ``radius`` of a segment border
    also sets a margin bit of the neighbouring segment.
    """
    segment = F.floor(F.col("i") / MASK_CELLS).cast("int")
    place = F.col("i") - segment * MASK_CELLS + MASK_MARGIN
    places = F.array(
        F.struct(segment.alias("segment"), place.alias("bit")),
        F.when(place >= MASK_MARGIN + MASK_CELLS - radius, F.struct((segment + 1).alias("segment"), (place - MASK_CELLS).alias("bit"))),
        F.when(place < MASK_MARGIN + radius, F.struct((segment - 1).alias("segment"), (place + MASK_CELLS).alias("bit"))),
    )
    rows = voxels.withColumn("p", F.explode(places)).where(F.col("p").isNotNull())
    return rows.groupBy("scene", "t", "state", "j", "k", F.col("p.segment").alias("segment")).agg(
        F.bit_or(bit_at(F.col("p.bit"))).alias("mask")
    )


def supported_voxels(voxels: DataFrame, *, radius: int = 1, min_neighbours: int = 1) -> DataFrame:
    """Keep a cell only if enough cells of the same state lie within ``radius`` cells per axis.

    Cells are packed into one bit mask per row segment. Each mask is sent to the (2 radius + 1)^2 rows
    around it, where neighbours are counted with bit operations: the shuffle carries row segments
    instead of cells, and there is neither a self join nor a list of neighbours. Copies of a cell set
    the same bit, so the voxel table need not be unique.
    """
    if not 1 <= radius <= MASK_MARGIN:
        raise ValueError(f"radius must be between 1 and {MASK_MARGIN}")
    span = range(-radius, radius + 1)
    moves = [(b, c) for b in span for c in span]
    offsets = F.array(*[F.struct(F.lit(b).alias("dj"), F.lit(c).alias("dk"), F.lit(n).alias("n")) for n, (b, c) in enumerate(moves)])
    sent = row_masks(voxels, radius).withColumn("o", F.explode(offsets)).select(
        "scene", "t", "state", (F.col("j") + F.col("o.dj")).alias("j"), (F.col("k") + F.col("o.dk")).alias("k"), "segment",
        "mask", F.col("o.n").alias("n"),
    )
    # Exactly one mask arrives from each side, so max only picks it.
    around = sent.groupBy("scene", "t", "state", "j", "k", "segment").agg(*[
        F.max(F.when(F.col("n") == n, F.col("mask"))).alias(f"m{n}") for n in range(len(moves))
    ])
    own = F.col(f"m{moves.index((0, 0))}")
    bits = F.sequence(F.lit(MASK_MARGIN), F.lit(MASK_MARGIN + MASK_CELLS - 1))
    cells = around.where(own.isNotNull()).withColumn("bit", F.explode(bits)).where(F.getbit(own, F.col("bit")) == 1)
    window = F.call_function("shiftleft", F.lit((1 << (2 * radius + 1)) - 1).cast("long"), F.col("bit") - radius)
    counts = [F.coalesce(F.bit_count(F.col(f"m{n}").bitwiseAND(window)), F.lit(0)) for n in range(len(moves))]
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    i = F.col("segment") * MASK_CELLS + F.col("bit") - MASK_MARGIN
    return cells.withColumn("neighbours", total - 1).where(F.col("neighbours") >= min_neighbours).select(
        "scene", "t", i.alias("i"), "j", "k", "state", "neighbours"
    )
