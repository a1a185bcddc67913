"""Voxel and ego-frame geometry as Column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def voxel_to_world(index: Column, origin: Column, voxel_size: Column) -> Column:
    """Centre of a voxel along one axis."""
    return origin + index * voxel_size


def world_to_voxel(value: Column, origin: Column, voxel_size: Column) -> Column:
    """Index of the voxel holding a coordinate along one axis; exact halves go to the even index."""
    return F.rint((value - origin) / voxel_size).cast("int")


def in_height_band(z: Column, ground_height: Column, height: Column | None) -> Column:
    """Strictly above the ground and at most ``height`` above it (None: no upper limit)."""
    above = z > ground_height
    return above if height is None else above & (z <= ground_height + height)


def band_layers(origin: float, voxel_size: float, ground_height: float, height: float | None) -> tuple[int, int | None]:
    """First and last voxel layer whose centre is in the height band, None for no last one; first > last if there is none.

    Centres do not fall as the layer rises, also when rounded, so the estimate is moved until the comparisons of
    :func:`in_height_band` on the same double expression agree.
    """
    if not (voxel_size > 0 and all(map(math.isfinite, (origin, voxel_size, ground_height, height or 0.0)))):
        raise ValueError("a grid needs finite numbers and a positive voxel size")

    def first_above(limit: float) -> int:
        k = math.floor((limit - origin) / voxel_size)
        while origin + k * voxel_size > limit:
            k -= 1
        while not origin + k * voxel_size > limit:
            k += 1
        return k

    return first_above(ground_height), None if height is None else first_above(ground_height + height) - 1


def in_grid(i: Column, j: Column, k: Column, shape: tuple[int, int, int]) -> Column:
    """Whether a cell index lies inside a grid of the given shape."""
    nx, ny, nz = shape
    return i.between(0, nx - 1) & j.between(0, ny - 1) & k.between(0, nz - 1)


def grid_bounds(shape: tuple[int, int, int], origin: tuple[float, float, float], voxel_size: float) -> list[tuple[float, float]]:
    """World range covered by a grid, per axis, from outer face to outer face."""
    half = voxel_size / 2.0
    return [(o - half, o + (n - 1) * voxel_size + half) for n, o in zip(shape, origin)]


def forward_of(x: Column, y: Column) -> Column:
    """Distance ahead of the ego; needs the frame's ex, ey, fwd_x, fwd_y columns."""
    return (x - F.col("ex")) * F.col("fwd_x") + (y - F.col("ey")) * F.col("fwd_y")


def lateral_of(x: Column, y: Column) -> Column:
    """Distance to the left of the ego; needs the frame's ex, ey, fwd_x, fwd_y columns."""
    return (x - F.col("ex")) * -F.col("fwd_y") + (y - F.col("ey")) * F.col("fwd_x")


def heading_columns(heading: Column) -> list[Column]:
    """fwd_x and fwd_y of a heading, to be stored on the frame."""
    return [F.cos(heading).alias("fwd_x"), F.sin(heading).alias("fwd_y")]
