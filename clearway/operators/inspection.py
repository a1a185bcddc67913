"""Looking into results: which frame, which surface, and what boxes alone cannot tell apart."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from clearway.functions.numbers import or_false
from clearway.functions.occupancy import OCCUPIED, POLICY_FREE
from clearway.operators import frame_metrics as fm
from clearway.operators.obstacles import ego_obstacles
from clearway.schemas import BOX_ATTRS, FRAME_KEY
from clearway.session import materialise

# Speed gate (m/s) and horizons (s) of the frame picks.
FAST = 8.33
CORRIDOR_HORIZON = 2.0
BLOCKED_HORIZON = 1.0

# Metrics that :func:`pick_frames` reads.
PICK_NEEDS = fm.Needs(
    clearance=True, path_horizons=(BLOCKED_HORIZON,), width_horizons=(CORRIDOR_HORIZON,), ego_width=True
)


def pick_frames(metrics: DataFrame) -> DataFrame:
    """The most telling frame per scene and rule; ties go to the smallest index.

    corridor: narrowest width among the matching frames, else overall. blocked: first blocked frame,
    else 0. tight: least clearance among fast frames, else overall. default: least clearance.
    """
    width = F.col(fm.width_column(CORRIDOR_HORIZON, POLICY_FREE))
    clearance = F.col(fm.clearance_column(POLICY_FREE))
    blocked = ~F.col(fm.path_column(BLOCKED_HORIZON, POLICY_FREE))
    matches = (width > 0) & (width < F.col("ego_width"))

    rows = materialise(metrics.select(
        "scene", "t", width.alias("width"), clearance.alias("clearance"), or_false(matches).alias("matches"),
        (F.col("speed") > FAST).alias("fast"), blocked.alias("blocked"),
    ))
    # The best value of each rule, then the first frame that has it: two hash aggregates instead of a sort of all frames.
    best = materialise(rows.groupBy("scene").agg(
        F.min(F.when(F.col("matches"), F.col("width"))).alias("_match"), F.min("width").alias("_width"),
        F.min(F.when(F.col("fast"), F.col("clearance"))).alias("_fast"), F.min("clearance").alias("_clearance"),
    ))

    def first(has: Column) -> Column:
        return F.min(F.when(has, F.col("t")))

    def preferred(flag: str, value: str, among: str, overall: str) -> Column:
        return F.coalesce(
            first(F.col(flag) & (F.col(value) == F.col(among))), first(F.col(among).isNull() & (F.col(value) == F.col(overall))))

    return rows.join(best, "scene").groupBy("scene").agg(
        preferred("matches", "width", "_match", "_width").alias("corridor"),
        F.coalesce(first(F.col("blocked")), F.lit(0)).alias("blocked"),
        preferred("fast", "clearance", "_fast", "_clearance").alias("tight"),
        first(F.col("clearance") == F.col("_clearance")).alias("default"),
    )


# Values of a cell index. Three indices, shifted to start at 0, are one decimal number whose order is that of (i, j, k).
INDEX_VALUES = 1 << 32


def clearance_witness(voxels: DataFrame, frames: DataFrame, lookahead: float = fm.LOOKAHEAD) -> DataFrame:
    """The obstacle that gives each frame its side clearance: smallest gap, then smallest i, j, k.

    Obstacles first shrink to one cell per distinct gap, a hash aggregate over plain numbers, so the
    ordered pick only sees a few rows per frame.
    """
    side = F.abs(F.col("lat"))
    rows = ego_obstacles(voxels, frames, policy=POLICY_FREE).where(
        (F.col("fwd") >= 0.0) & (F.col("fwd") <= F.lit(lookahead)) & (side > fm.half_corridor())
    )
    def digit(c: str) -> Column:
        return F.col(c).cast("long").cast("decimal(20,0)") + F.lit(Decimal(INDEX_VALUES // 2))

    high, low = F.lit(Decimal(INDEX_VALUES * INDEX_VALUES)), F.lit(Decimal(INDEX_VALUES))
    cell = (digit("i") * high + digit("j") * low + digit("k")).cast("decimal(38,0)")
    gaps = rows.groupBy(*FRAME_KEY, (side - fm.half_corridor()).alias("clearance")).agg(F.min(cell).alias("cell"))
    best = gaps.groupBy(*FRAME_KEY).agg(F.min(F.struct("clearance", "cell")).alias("w"))
    best = best.select(*FRAME_KEY, "w.clearance", "w.cell")
    half, plane = INDEX_VALUES // 2, INDEX_VALUES * INDEX_VALUES
    picked = best.select(
        *FRAME_KEY, "clearance", F.expr(f"cast(cell div {plane}BD - {half} as int)").alias("i"),
        F.expr(f"cast((cell % {plane}BD) div {INDEX_VALUES}BD - {half} as int)").alias("j"),
        F.expr(f"cast(cast(cell % {INDEX_VALUES}BD as long) - {half} as int)").alias("k"), F.lit(OCCUPIED).alias("state"),
    )
    return ego_obstacles(picked, frames, policy=POLICY_FREE).select(*FRAME_KEY, "fwd", "lat", "clearance", "i", "j", "k")


def corridor_witness(voxels: DataFrame, frames: DataFrame, horizon: float = CORRIDOR_HORIZON) -> DataFrame:
    """The station that gives each frame its corridor width, with the surfaces on both sides.

    Smallest gap, then the nearest station. Gaps below one voxel are reported as measured.
    """
    half = F.col("voxel_size") / 2.0
    reach = F.col("fwd") <= fm.body_reach(horizon) + F.col("voxel_size")
    rows = fm.by_station(
        ego_obstacles(voxels, frames, policy=POLICY_FREE).where(reach & (F.col("lat") != 0)), keep_all=False
    ).where(fm.in_reach(horizon))
    sides = rows.groupBy(*FRAME_KEY, "station").agg(
        F.min(F.when(F.col("lat") > 0, F.col("lat") - half)).alias("left"),
        F.max(F.when(F.col("lat") < 0, F.col("lat") + half)).alias("right"),
        F.min(F.col("station") * F.col("voxel_size")).alias("at"),
    )
    gap = F.greatest(F.lit(0.0), F.col("left")) + F.greatest(F.lit(0.0), -F.col("right"))
    both = sides.where(F.col("left").isNotNull() & F.col("right").isNotNull()).withColumn("gap", gap)
    best = both.groupBy(*FRAME_KEY).agg(F.min(F.struct("gap", "station", "at", "left", "right")).alias("w"))
    return best.select(*FRAME_KEY, "w.gap", "w.station", "w.at", "w.left", "w.right")


def counted_boxes(boxes: DataFrame, keys: list[str], seen: list[str]) -> DataFrame:
    """The distinct boxes of each unit (``keys``) as far as they are ``seen``, and how often each occurs, ``_n``."""
    return boxes.groupBy(*keys, *seen).agg(F.count("*").alias("_n"))


def box_fingerprint(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Order-free fingerprint of the counted boxes of each unit: sizes plus two 64-bit set hashes.

    The set has no repeats, so XOR cannot cancel; it combines map-side, and no list of boxes is ever built.
    """
    parts = [c for c in counted.columns if c not in keys]
    return counted.groupBy(*keys).agg(
        F.sum("_n").alias("n_boxes"), F.count("*").alias("n_distinct"),
        F.bit_xor(F.xxhash64(F.lit(1), *parts)).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(2), *parts)).alias("h2"),
    )


OBSERVATION = ["n_boxes", "n_distinct", "h1", "h2"]


def confirmed_observations(units: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """Units with ``observation``, the keys of a unit whose boxes equal theirs exactly; equal boxes get equal observations.

    In each group of equal fingerprints one unit stands for the group. The counted boxes of every other unit are joined to its boxes, and
    a unit that agrees in all of them is confirmed. Units that do not agree, which a clash of hashes leaves over, go round again
    with one of their own; a round confirms at least its representatives. A representative has each box once, so rows do not multiply.
    """
    left, found = units, None
    while True:
        heads = left.groupBy(*OBSERVATION).agg(F.min(F.struct(*keys)).alias("observation"))
        pairs = left.join(heads, OBSERVATION)
        theirs = heads.select("observation", *[F.col(f"observation.{k}").alias(k) for k in keys]).join(counted, keys).drop(*keys)
        same = [F.col("a.observation") == F.col("b.observation")] + [
            F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in counted.columns if c not in keys]
        mine = pairs.select(*keys, "observation").join(counted, keys).alias("a")
        agreed = mine.join(theirs.alias("b"), same).groupBy(*[F.col(f"a.{k}") for k in keys]).agg(F.count("*").alias("agreed"))
        checked = materialise(pairs.join(agreed, keys, "left").withColumn("equal", or_false(F.col("agreed") == F.col("n_distinct"))))
        confirmed = checked.where("equal").drop("agreed", "equal")
        found = confirmed if found is None else found.unionByName(confirmed)
        left = checked.where("NOT equal").select(*units.columns)
        if left.isEmpty():
            return found


def indistinguishable_units(
    answers: DataFrame, boxes: DataFrame, keys: list[str], seen: list[str] | None = None,
    fingerprint: Callable[[DataFrame, list[str]], DataFrame] = box_fingerprint,
) -> DataFrame:
    """Units whose boxes equal those of another unit that gives a different occupancy answer.

    ``answers`` has the keys and a BOOLEAN ``answer``. ``seen`` names the box columns that an observer knows; by default it
    knows all attributes and, of a scene, the frame of each box. No function of the boxes can return the right
    answer for all rows of one observation. Fingerprints only choose the groups in which answers differ; there boxes are compared
    themselves. Units without boxes share the empty observation, which may be most of them, so
    they are counted on their own and never joined; both sides of the joins are written tables, whose large keys are split.
    """
    columns = [*(c for c in FRAME_KEY if c not in keys), *BOX_ATTRS] if seen is None else seen
    counted = materialise(counted_boxes(boxes, keys, columns))
    units = materialise(answers.join(fingerprint(counted, keys), keys, "left"))
    sizes = [F.count("*").alias("group_size"), F.count_if("answer").alias("group_matches")]
    differ = (F.col("group_matches") > 0) & (F.col("group_matches") < F.col("group_size"))
    boxed, empty = units.where(F.col("n_boxes").isNotNull()), units.where(F.col("n_boxes").isNull())
    likely = boxed.groupBy(*OBSERVATION).agg(*sizes).where(differ).drop("group_size", "group_matches")
    exact = confirmed_observations(materialise(boxed.join(likely, OBSERVATION)), counted, keys)
    groups = exact.groupBy("observation").agg(*sizes).where(differ)
    found = empty.agg(*sizes).first()
    alone = empty.fillna(0, ["n_boxes"]).withColumns({n: F.lit(found[n]) for n in ("group_size", "group_matches")}).where(differ)
    hashes = ["n_distinct", "h1", "h2"]
    return exact.join(groups, "observation").drop("observation", *hashes).unionByName(alone.drop(*hashes))
