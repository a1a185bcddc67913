"""Lifting frame conditions over time, and values that depend on neighbouring frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clearway.functions.numbers import or_false
from clearway.plans.windows import core_rows, in_blocks


def transition_hits(frames: DataFrame, pairs: dict[str, tuple[Column, Column, int]]) -> DataFrame:
    """Add a BOOLEAN column per pair (before, after, within): ``before`` holds here and ``after`` holds
    at a strictly later frame of the scene, at most ``within`` frame indices away."""
    reach = max(within for _, _, within in pairs.values())
    flagged = frames
    for name, (before, after, _) in pairs.items():
        flagged = flagged.withColumn(f"_b_{name}", before).withColumn(f"_a_{name}", after)
    blocked, spec = in_blocks(flagged, ["scene"], "t", back=0, ahead=reach)
    for name, (_, _, within) in pairs.items():
        later = F.max(f"_a_{name}").over(spec.rangeBetween(1, within)) if within >= 1 else F.lit(False)
        blocked = blocked.withColumn(name, or_false(F.col(f"_b_{name}") & later))
    return core_rows(blocked).drop(*[f"_{s}_{n}" for n in pairs for s in "ab"])


def scope_flags(frames: DataFrame, flags: dict[str, tuple[str, str]], scenes: DataFrame | None = None) -> DataFrame:
    """One row per scene, lifting BOOLEAN frame columns: ``flags`` maps name -> (column, scope).

    Scope ``any`` (and ``transition``, on hits) is false and ``all`` is true for a scene without frames;
    such scenes appear if ``scenes`` lists them. A NULL flag counts as false.
    """
    lift = {"any": F.max, "transition": F.max, "all": F.min}
    empty = {"any": False, "transition": False, "all": True}
    for _, scope in flags.values():
        if scope not in lift:
            raise ValueError(f"unknown scope: {scope}")
    out = frames.groupBy("scene").agg(*[lift[s](or_false(F.col(c))).alias(n) for n, (c, s) in flags.items()])
    if scenes is not None:
        out = scenes.select("scene").distinct().join(out, "scene", "left")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(empty[s])) for n, (_, s) in flags.items()})


def persistent(frames: DataFrame, condition: Column, at_least: int, name: str = "persistent") -> DataFrame:
    """Flag frames that belong to a run of at least ``at_least`` consecutive frames with ``condition``."""
    reach = at_least - 1
    blocked, spec = in_blocks(frames.withColumn("_c", condition.cast("int")), ["scene"], "t", back=reach, ahead=reach)
    # A run that covers this frame ends at this frame or at most ``reach`` frames later.
    ends = F.sum("_c").over(spec.rangeBetween(-reach, 0)) == at_least
    blocked = blocked.withColumn("_end", or_false(ends))
    blocked = blocked.withColumn(name, F.max("_end").over(spec.rangeBetween(0, reach)))
    return core_rows(blocked).drop("_c", "_end")


def ego_speed(poses: DataFrame) -> DataFrame:
    """Speed from consecutive poses: to the next frame, or from the previous one for the last frame.

    Needs the dense index ``t``; zero if the scene has one frame or the two stamps are equal.
    """
    blocked, spec = in_blocks(poses, ["scene"], "t", back=1, ahead=1)

    def neighbour(column: str) -> Column:
        return F.when(F.lead("t").over(spec).isNotNull(), F.lead(column).over(spec)).otherwise(F.lag(column).over(spec))

    blocked = blocked.withColumns({f"_n_{c}": neighbour(c) for c in ("tx", "ty", "ts_us")})
    dx, dy = F.col("_n_tx") - F.col("tx"), F.col("_n_ty") - F.col("ty")
    dt = F.abs(F.col("_n_ts_us") - F.col("ts_us")) / F.lit(1e6)
    moved = F.when(dt > 0, F.sqrt(dx * dx + dy * dy) / dt)
    return core_rows(blocked.withColumn("speed", F.coalesce(moved, F.lit(0.0)))).drop("_n_tx", "_n_ty", "_n_ts_us")


def first_frame_value(frames: DataFrame, *columns: str) -> DataFrame:
    """Values of columns at the first frame of each scene, also where frame numbers do not start at 0."""
    return frames.groupBy("scene").agg(*[F.min_by(c, "t").alias(c) for c in columns])


def transition_hits_by_join(frames: DataFrame, before: Column, after: Column, within: int) -> DataFrame:
    """Scenes with a transition, by an equi-join on the later frame; for small ``within`` and as a check."""
    starts = frames.where(before).select("scene", F.explode(F.sequence(F.col("t") + 1, F.col("t") + within)).alias("t"))
    return starts.join(frames.where(after).select("scene", "t"), ["scene", "t"], "left_semi").select("scene").distinct()
