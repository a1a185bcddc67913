"""From frame metrics to matching scenes: all queries and policies in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from clearway.functions.occupancy import METRIC_POLICIES, POLICY_FREE, POLICY_IGNORED, POLICY_OCCUPIED
from clearway.operators.frame_metrics import frame_metrics, occupancy_metrics
from clearway.operators.temporal import scope_flags, transition_hits
from clearway.plans.catalogue import FrameView, Query, needs_of
from clearway.plans.joins import with_attrs
from clearway.schemas import FRAME_ATTRS


def match_matrix(
    metrics: DataFrame, queries: Sequence[Query], scenes: DataFrame | None = None, policies: Sequence[str] = METRIC_POLICIES
) -> DataFrame:
    """One row per scene with a BOOLEAN column ``<query id>__<policy>`` per query and policy."""
    if len({q.id for q in queries}) < len(queries):
        raise ValueError("query ids must be distinct")
    columns: dict[str, Column] = {}
    moves: dict[str, tuple[Column, Column, int]] = {}
    flags: dict[str, tuple[str, str]] = {}
    for q in queries:
        for policy in policies:
            view, name = FrameView(policy), f"{q.id}__{policy}"
            flags[name] = (name, q.scope)
            if q.scope == "transition":
                moves[name] = (q.before(view), q.after(view), q.within_frames)
            else:
                # The gate is a part of the condition, whichever frames other queries of the batch let through.
                columns[name] = q.predicate(view) & q.gate(view) if q.gate else q.predicate(view)
    frames = metrics
    if moves:
        # Conditions first, so that only BOOLEANs travel through the window.
        frames = frames.select(
            "scene", "t", *[c.alias(n) for n, c in columns.items()],
            *[c.alias(f"_before_{n}") for n, (c, _, _) in moves.items()],
            *[c.alias(f"_after_{n}") for n, (_, c, _) in moves.items()],
        )
        frames = transition_hits(
            frames, {n: (F.col(f"_before_{n}"), F.col(f"_after_{n}"), w) for n, (_, _, w) in moves.items()}
        )
    else:
        frames = frames.select("scene", *[c.alias(n) for n, c in columns.items()])
    return scope_flags(frames, flags, scenes)


def scene_flags(matrix: DataFrame, queries: Sequence[Query], policies: Sequence[str] = METRIC_POLICIES) -> DataFrame:
    """Long form of the matrix: one row per (query_id, scene) with a BOOLEAN column per policy."""
    entries = [
        F.struct(F.lit(q.id).alias("query_id"), *[F.col(f"{q.id}__{p}").alias(p) for p in policies]) for q in queries
    ]
    rows = matrix.select("scene", F.explode(F.array(*entries)).alias("e"))
    return rows.select("e.query_id", "scene", *[f"e.{p}" for p in policies])


def policy_sets(flags: DataFrame) -> DataFrame:
    """Add set membership across policies to rows with ``free`` and ``occupied`` columns.

    ``ignored``: matches either way (intersection). ``undetermined``: flips (symmetric difference).
    """
    return flags.withColumn(POLICY_IGNORED, F.col(POLICY_FREE) & F.col(POLICY_OCCUPIED)).withColumn(
        "undetermined", F.col(POLICY_FREE) != F.col(POLICY_OCCUPIED)
    )


def retrieve(metrics: DataFrame, queries: Sequence[Query], scenes: DataFrame | None = None) -> DataFrame:
    """Matching scenes as distinct rows (query_id, policy, scene) for the free, occupied and ignored policies."""
    flags = policy_sets(scene_flags(match_matrix(metrics, queries, scenes), queries))
    names = (POLICY_FREE, POLICY_OCCUPIED, POLICY_IGNORED)
    members = F.array(*[F.when(F.col(p), F.lit(p)) for p in names])
    rows = flags.select("query_id", F.explode(members).alias("policy"), "scene")
    return rows.where(F.col("policy").isNotNull())


def retrieve_where(metrics: DataFrame, condition: Column, scope: str = "any", scenes: DataFrame | None = None) -> DataFrame:
    """Scenes matching a plain Column condition over the metrics table (scope any or all)."""
    hit = scope_flags(metrics.select("scene", condition.alias("hit")), {"hit": ("hit", scope)}, scenes)
    return hit.where("hit").select("scene")


def retrieve_transition(metrics: DataFrame, before: Column, after: Column, within: int) -> DataFrame:
    """Scenes where ``before`` holds and ``after`` holds at most ``within`` frames later."""
    hits = transition_hits(metrics, {"hit": (before, after, within)})
    return hits.where("hit").select("scene").distinct()


def retrieve_by_variant(frames: DataFrame, voxels: DataFrame, variants: Sequence[str], queries: Sequence[Query]) -> DataFrame:
    """Retrieval on several readings of the same volumes (for example one per visibility mask).

    ``voxels`` has a column ``variant``. The variant becomes part of the scene key once voxels are metrics, so all readings share
    one scan and one pass, and what is shuffled under the new key is a few numbers per frame. Returns (variant, query_id, policy, scene).
    """
    keyed = F.struct("variant", "scene")
    every = F.explode(F.array(*[F.lit(v) for v in variants]))
    needs = needs_of(queries)
    occupancy = occupancy_metrics(with_attrs(voxels, frames, FRAME_ATTRS), frames, needs, ["variant"])
    frames = frames.withColumn("variant", every).withColumn("scene", keyed).drop("variant")
    occupancy = occupancy.withColumn("scene", keyed).drop("variant")
    found = retrieve(frame_metrics(frames, None, None, needs, occupancy), queries)
    return found.select("scene.variant", "query_id", "policy", "scene.scene")
