"""Queries: conditions on frame metrics, plus a scope over time.

A condition is a function of a :class:`FrameView`, whose methods return ordinary Columns, so any Column
algebra can be used: ``lambda f: (f.lateral_clearance() < 0.5) & (f.ego_speed() > 8.33)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, functions as F

from clearway.functions.occupancy import POLICY_FREE
from clearway.operators import frame_metrics as fm


class FrameView:
    """Metrics of the current frame under one unknown policy. Remembers which ones were used."""

    def __init__(self, policy: str = POLICY_FREE):
        self.policy = policy
        self.needs = fm.Needs()

    def _use(self, column: str, **more) -> Column:
        self.needs = replace(self.needs, **more)
        return F.col(f"`{column}`")

    def lateral_clearance(self) -> Column:
        return self._use(fm.clearance_column(self.policy), clearance=True)

    def centerline_lateral_distance(self) -> Column:
        return self._use(fm.centerline_column(self.policy), centerline=True)

    def free_along_ego_path(self, horizon: float) -> Column:
        return self._use(fm.path_column(horizon, self.policy), path_horizons=(*self.needs.path_horizons, horizon))

    def min_free_width_along_path(self, horizon: float) -> Column:
        return self._use(fm.width_column(horizon, self.policy), width_horizons=(*self.needs.width_horizons, horizon))

    def distance_to_nearest_object(self, object_class: str | None = None) -> Column:
        return self._use(fm.box_column(object_class), labels=(*self.needs.labels, object_class))

    def ego_speed(self) -> Column:
        return F.col("speed")

    def ego_width(self) -> Column:
        return self._use("ego_width", ego_width=True)


Condition = Callable[[FrameView], Column]


# What a query may declare.
SCOPES = ("any", "all", "transition")
BACKENDS = ("occupancy", "tracking")
STATUSES = ("implemented", "baseline_only")


@dataclass(frozen=True)
class Query:
    """One retrieval query; ``transition`` uses before / after / within_frames, the other scopes predicate."""

    id: str
    text: str
    backend: str = "occupancy"
    status: str = "implemented"
    scope: str = "any"
    box_expressible: bool = False
    predicate: Condition | None = None
    before: Condition | None = None
    after: Condition | None = None
    within_frames: int = 0
    # Scope any only: a part of the predicate (joined by "and") that needs no voxels, to skip frames early.
    gate: Condition | None = None

    def __post_init__(self) -> None:
        moving = self.scope == "transition"
        rules = {
            "scope is any, all or transition": self.scope in SCOPES,
            "backend is occupancy or tracking": self.backend in BACKENDS,
            "status is implemented or baseline_only": self.status in STATUSES,
            "transition has before, after and a positive within_frames, and nothing else does":
                moving == (self.before is not None) == (self.after is not None) == (self.within_frames >= 1),
            "any and all have a predicate, transition has none": moving == (self.predicate is None),
            "only scope any may have a gate": self.gate is None or self.scope == "any",
        }
        broken = [rule for rule, kept in rules.items() if not kept]
        if broken:
            raise ValueError(f"query {self.id}: {'; '.join(broken)}")

    @property
    def is_occupancy(self) -> bool:
        return self.backend == "occupancy" and self.status == "implemented"

    @property
    def conditions(self) -> list[Condition]:
        return [c for c in (self.predicate, self.before, self.after) if c is not None]


def needs_of(queries: Iterable[Query], **more) -> fm.Needs:
    """The metrics a set of queries uses, so that nothing else is computed.

    Frames that pass no gate are skipped if every voxel query has one.
    """
    queries = list(queries)
    total = fm.Needs()
    gates: list[Column | None] = []
    for q in queries:
        view = FrameView()
        for condition in q.conditions:
            condition(view)
        n = view.needs
        if n.voxel_metrics:
            gates.append(q.gate(FrameView()) if q.gate else None)
        total = fm.Needs(
            total.centerline or n.centerline,
            total.clearance or n.clearance,
            tuple(dict.fromkeys((*total.path_horizons, *n.path_horizons))),
            tuple(dict.fromkeys((*total.width_horizons, *n.width_horizons))),
            tuple(dict.fromkeys((*total.labels, *n.labels))),
            total.ego_width or n.ego_width,
        )
    if gates and all(g is not None for g in gates):
        total = replace(total, gate=reduce(lambda a, b: a | b, gates))
    return replace(total, **more)


# Ids, scopes and thresholds of the catalogued queries.
TIGHT_CLEARANCE = Query(
    id="tight_clearance_at_speed",
    text="side gap under half a metre above 8.33 m/s",
    predicate=lambda f: (f.lateral_clearance() < 0.5) & (f.ego_speed() > 8.33),
    gate=lambda f: f.ego_speed() > 8.33,
)
CORRIDOR_NARROWS = Query(
    id="corridor_narrows_below_vehicle_width",
    text="less room between the sides than the ego is wide, within two seconds",
    predicate=lambda f: (f.min_free_width_along_path(2.0) > 0) & (f.min_free_width_along_path(2.0) < f.ego_width()),
)
BLOCKED_THEN_CLEARS = Query(
    id="blocked_then_clears",
    text="swept path closed, then open at most three frames later",
    scope="transition",
    before=lambda f: ~f.free_along_ego_path(1.0),
    after=lambda f: f.free_along_ego_path(1.0),
    within_frames=3,
)
NEAR_VEHICLE = Query(
    id="near_a_tracked_vehicle",
    text="vehicle box centre nearer than two metres",
    backend="tracking",
    status="baseline_only",
    box_expressible=True,
    predicate=lambda f: f.distance_to_nearest_object("vehicle") < 2.0,
)
CATALOGUE = (TIGHT_CLEARANCE, CORRIDOR_NARROWS, BLOCKED_THEN_CLEARS, NEAR_VEHICLE)
