"""The hub table: one row per frame with every metric under both readings of unobserved space.

Voxels are read once. Each row feeds conditional min / max aggregates, which combine map-side, so what
is shuffled is a few numbers per frame (per station for the corridor width), never voxels. The metrics
do not change if a cell is listed twice, so the voxel table need not be deduplicated first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from clearway.functions.numbers import or_false, or_inf
from clearway.functions.occupancy import METRIC_POLICIES, POLICY_FREE, POLICY_IGNORED
from clearway.operators.obstacles import ego_obstacles
from clearway.operators.temporal import first_frame_value
from clearway.plans.joins import with_attrs
from clearway.schemas import FRAME_KEY

# How far ahead the lateral metrics look (m), and the slack of the last station (m).
LOOKAHEAD = 20.0
STATION_SLACK = 1e-9


@dataclass(frozen=True)
class Needs:
    """Which metrics to compute.

    ``abeam`` limits the clearance to obstacles at most that far ahead. ``gate`` is a condition on frame
    columns such as ``speed``: voxels of other frames are dropped before any geometry, so those frames
    read as empty.
    """

    centerline: bool = False
    clearance: bool = False
    path_horizons: tuple[float, ...] = ()
    width_horizons: tuple[float, ...] = ()
    labels: tuple[str | None, ...] = ()
    ego_width: bool = False
    lookahead: float = LOOKAHEAD
    abeam: float | None = None
    gate: Column | None = None

    @property
    def voxel_metrics(self) -> bool:
        return bool(self.centerline or self.clearance or self.path_horizons or self.width_horizons)


ALL_METRICS = Needs(True, True, (1.0,), (2.0,), ("vehicle",), True)


def seconds(horizon: float) -> str:
    """Horizon as part of a column name: 2.0 -> '2s', 0.5 -> '0p5s'."""
    return f"{horizon:g}s".replace(".", "p")


def metric_policy(policy: str) -> str:
    """The reading a metric is computed under: ignored unknowns count as free inside a predicate."""
    return POLICY_FREE if policy == POLICY_IGNORED else policy


def centerline_column(policy: str) -> str:
    return f"centerline_{metric_policy(policy)}"


def clearance_column(policy: str) -> str:
    return f"clearance_{metric_policy(policy)}"


def path_column(horizon: float, policy: str) -> str:
    return f"path_free_{seconds(horizon)}_{metric_policy(policy)}"


def width_column(horizon: float, policy: str) -> str:
    return f"free_width_{seconds(horizon)}_{metric_policy(policy)}"


def box_column(label: str | None) -> str:
    return "box_distance" if label is None else f"box_distance_{label}"


def half_corridor() -> Column:
    """Half the ego width padded by half a voxel."""
    return F.col("width") / 2.0 + F.col("voxel_size") / 2.0


def body_reach(horizon: float) -> Column:
    """From the ego centre to the nose, plus the distance driven in ``horizon`` seconds."""
    return F.col("length") / 2.0 + F.col("speed") * F.lit(float(horizon))


def under(policy: str, condition: Column) -> Column:
    """Rows of ``ego_obstacles`` that count under a policy; UNKNOWN rows only count as occupied."""
    return condition & F.col("solid") if policy == POLICY_FREE else condition


def by_station(obstacles: DataFrame, *, keep_all: bool) -> DataFrame:
    """One row per (obstacle, station); ``keep_all`` keeps obstacles of no station under a NULL one.

    The slice of a station reaches half a voxel to both sides, so an obstacle can only touch the stations
    just below and just above it. Membership is the exact double comparison |fwd - k * voxel| <= voxel / 2.
    Obstacles of no station are dropped by exploding NULL: a filter would be pushed down and repeat the
    whole geometry inside itself.
    """
    below = F.floor(F.col("fwd") / F.col("voxel_size")).cast("int")
    rows = obstacles.withColumn("_below", below)

    def touches(k: Column) -> Column:
        return (k >= 0) & (F.abs(F.col("fwd") - k * F.col("voxel_size")) <= F.col("voxel_size") / 2.0)

    k = F.col("_below")
    rows = rows.withColumn("_at", touches(k)).withColumn("_next", touches(k + 1))
    stations = (
        F.when(F.col("_at") & F.col("_next"), F.array(k, k + 1))
        .when(F.col("_at"), F.array(k))
        .when(F.col("_next"), F.array(k + 1))
    )
    if keep_all:
        stations = stations.otherwise(F.array(F.lit(None).cast("int")))
    return rows.withColumn("station", F.explode(stations)).drop("_below", "_at", "_next")


def in_reach(horizon: float) -> Column:
    """Whether a station lies on the path driven in ``horizon`` seconds."""
    return F.col("station") * F.col("voxel_size") <= body_reach(horizon) + F.lit(STATION_SLACK)


def _row_aggregates(needs: Needs) -> list[Column]:
    """Aggregates over obstacle rows for the centreline, clearance and path metrics."""
    out = []
    side = F.abs(F.col("lat"))
    ahead = (F.col("fwd") >= 0.0) & (F.col("fwd") <= F.lit(needs.lookahead))
    beside = ahead & (side > half_corridor())
    if needs.abeam is not None:
        beside = beside & (F.abs(F.col("fwd")) <= F.lit(float(needs.abeam)))
    for policy in METRIC_POLICIES:
        if needs.centerline:
            out.append(F.min(F.when(under(policy, ahead), side)).alias(centerline_column(policy)))
        if needs.clearance:
            gap = side - half_corridor()
            out.append(F.min(F.when(under(policy, beside), gap)).alias(clearance_column(policy)))
        for h in needs.path_horizons:
            reach = body_reach(h) + F.col("voxel_size") / 2.0
            hit = (F.col("fwd") >= 0.0) & (F.col("fwd") <= reach) & (side <= half_corridor())
            out.append(F.max(under(policy, hit)).alias(path_column(h, policy)))
    return out


def _side_aggregates(needs: Needs) -> list[Column]:
    """Per station: nearest surface to the left and right, and which horizons reach the station."""
    half = F.col("voxel_size") / 2.0
    out = [F.max(in_reach(h)).alias(f"_reach_{seconds(h)}") for h in needs.width_horizons]
    for policy in METRIC_POLICIES:
        left = F.greatest(F.lit(0.0), F.col("lat") - half)
        right = F.greatest(F.lit(0.0), -F.col("lat") - half)
        out.append(F.min(F.when(under(policy, F.col("lat") > 0), left)).alias(f"_left_{policy}"))
        out.append(F.min(F.when(under(policy, F.col("lat") < 0), right)).alias(f"_right_{policy}"))
    return out


def _relevant(needs: Needs) -> Column:
    """Rows that can change some requested metric; the rest is dropped before aggregation."""
    ranges = [F.lit(False)]
    if needs.centerline or needs.clearance:
        ranges.append((F.col("fwd") >= 0.0) & (F.col("fwd") <= F.lit(needs.lookahead)))
    for h in {*needs.path_horizons, *needs.width_horizons}:
        # One voxel of slack on both ends; the exact bounds are applied by the aggregates.
        ranges.append((F.col("fwd") >= -F.col("voxel_size")) & (F.col("fwd") <= body_reach(h) + F.col("voxel_size")))
    keep = ranges[0]
    for r in ranges[1:]:
        keep = keep | r
    return keep


def occupancy_metrics(voxels: DataFrame, frames: DataFrame, needs: Needs, variant: list[str] = []) -> DataFrame:
    """Metrics of the frames that hold at least one relevant obstacle; NULL means "no answer".

    Columns of ``variant`` tell several readings of a frame apart; they come after its key, so voxels dealt by frame stay where they are.
    """
    keys = [*FRAME_KEY, *variant]
    obstacles = ego_obstacles(voxels, frames).where(_relevant(needs))
    if needs.gate is not None:
        obstacles = obstacles.where(needs.gate)
    if not needs.width_horizons:
        return obstacles.groupBy(*keys).agg(*_row_aggregates(needs))
    first = (
        by_station(obstacles, keep_all=len(_row_aggregates(needs)) > 0)
        .groupBy(*keys, "station")
        .agg(*_row_aggregates(needs), *_side_aggregates(needs))
    )
    second = []
    for policy in METRIC_POLICIES:
        if needs.centerline:
            second.append(F.min(centerline_column(policy)).alias(centerline_column(policy)))
        if needs.clearance:
            second.append(F.min(clearance_column(policy)).alias(clearance_column(policy)))
        second += [F.max(path_column(h, policy)).alias(path_column(h, policy)) for h in needs.path_horizons]
        for h in needs.width_horizons:
            # NULL unless both sides are bounded.
            gap = F.col(f"_left_{policy}") + F.col(f"_right_{policy}")
            here = F.col("station").isNotNull() & F.col(f"_reach_{seconds(h)}")
            second.append(F.min(F.when(here, gap)).alias(width_column(h, policy)))
    return first.groupBy(*keys).agg(*second)


def box_metrics(boxes: DataFrame, frames: DataFrame, labels: tuple[str | None, ...]) -> DataFrame:
    """Planar distance to the nearest box per label (None = any label), for frames with boxes."""
    rows = with_attrs(boxes, frames, ["ex", "ey"])
    dx, dy = F.col("cx") - F.col("ex"), F.col("cy") - F.col("ey")
    distance = F.hypot(dx, dy)
    return rows.groupBy(*FRAME_KEY).agg(*[
        F.min(distance if label is None else F.when(F.col("label") == label, distance)).alias(box_column(label))
        for label in labels
    ])


def first_frame_width(frames: DataFrame) -> DataFrame:
    """Ego width of a scene, which is always that of its first frame."""
    return first_frame_value(frames, "width").withColumnRenamed("width", "ego_width")


def frame_metrics(frames: DataFrame, voxels: DataFrame | None, boxes: DataFrame | None = None, needs: Needs = ALL_METRICS, occupancy: DataFrame | None = None) -> DataFrame:
    """One row per frame: speed, width and the requested metrics, inf where there is no answer.

    ``occupancy`` hands over the rows of :func:`occupancy_metrics` instead of voxels.
    """
    out = frames.select(*FRAME_KEY, "speed", "width", "voxel_size")
    if needs.voxel_metrics:
        out = out.join(occupancy_metrics(voxels, frames, needs) if occupancy is None else occupancy, FRAME_KEY, "left")
    if needs.labels:
        out = out.join(box_metrics(boxes, frames, needs.labels), FRAME_KEY, "left")
    if needs.ego_width:
        out = out.join(first_frame_width(frames), "scene", "left")
    filled = {}
    for policy in METRIC_POLICIES:
        if needs.centerline:
            filled[centerline_column(policy)] = or_inf(F.col(centerline_column(policy)))
        if needs.clearance:
            filled[clearance_column(policy)] = or_inf(F.col(clearance_column(policy)))
        for h in needs.path_horizons:
            filled[path_column(h, policy)] = ~or_false(F.col(path_column(h, policy)))
        for h in needs.width_horizons:
            # A gap below one voxel cannot be resolved and reads as closed.
            w = F.col(width_column(h, policy))
            filled[width_column(h, policy)] = or_inf(F.when(w < F.col("voxel_size"), 0.0).otherwise(w))
    for label in needs.labels:
        filled[box_column(label)] = or_inf(F.col(f"`{box_column(label)}`"))
    return out.withColumns(filled).drop("voxel_size")
