"""Occupancy codes, unknown policies and the class-to-state mapping."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Occupancy encoding.
OCCUPIED = 1
FREE = 0
UNKNOWN = -1

# Semantic classes of the label volumes. 17 is free space; 11 driveable surface,
# 12 other flat, 13 sidewalk and 14 terrain are ground and count as free too.
FREE_CLASS = 17
GROUND_CLASSES = (11, 12, 13, 14)

# The three readings of unobserved space.
POLICY_FREE = "free"
POLICY_OCCUPIED = "occupied"
POLICY_IGNORED = "ignored"
# Readings a frame metric is computed under; ``ignored`` is a rule on result sets.
METRIC_POLICIES = (POLICY_FREE, POLICY_OCCUPIED)


def class_state(cls: Column, mask: Column | None = None) -> Column:
    """State of a cell from its semantic class; a visibility mask of 0 overrides the class."""
    by_class = F.when(cls.isin(FREE_CLASS, *GROUND_CLASSES), F.lit(FREE)).otherwise(F.lit(OCCUPIED))
    if mask is None:
        return by_class
    return F.when(mask == 0, F.lit(UNKNOWN)).otherwise(by_class)


def masked_class_state(cls: Column, mask_lidar: Column, mask_camera: Column, mask: str = "lidar") -> Column:
    """:func:`class_state` with the mask chosen by name; any other name gives the dense reading."""
    chosen = {"lidar": mask_lidar, "camera": mask_camera}.get(mask)
    return class_state(cls, chosen)


def blocks(state: Column, policy: str) -> Column:
    """Whether a cell counts as an obstacle under an unknown policy (ignored behaves as free)."""
    if policy == POLICY_OCCUPIED:
        return state.isin(OCCUPIED, UNKNOWN)
    if policy in (POLICY_FREE, POLICY_IGNORED):
        return state == OCCUPIED
    raise ValueError(f"unknown policy: {policy}")
