"""Temporal order of the frames of a scene, as given by prev / next links."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from clearway.functions.numbers import or_false
from clearway.plans.windows import core_rows, in_blocks, largest_group, number_rows
from clearway.session import materialise

# Link fields that point nowhere.
END_MARKS = ("", "EOF")


def _ends(link: Column) -> Column:
    return link.isNull() | link.isin(*END_MARKS)


def file_order(poses: DataFrame) -> list[str]:
    """The columns that give the order of the rows of a scene in its files."""
    return [c for c in ("doc", "pos") if c in poses.columns]


def scene_heads(poses: DataFrame) -> DataFrame:
    """Head token of each scene: the first row in file order whose ``prev`` points nowhere."""
    heads = poses.where(_ends(F.col("prev"))).groupBy("scene").agg(F.min_by("token", F.struct(*file_order(poses))).alias("head"))
    # An empty token cannot start a chain; such a scene falls back to file order.
    return heads.where(F.col("head") != "")


def stamp_ordered_scenes(poses: DataFrame) -> DataFrame:
    """Scenes whose link chain is exactly the order by time stamp: adds ``t`` and ``linked`` per row.

    True if the row at 0 is the head and every row but the last links to its successor; the chain then
    visits all rows, and wherever the last link points it ends there.
    """
    numbered = number_rows(poses, ["scene"], ["ts_us", "token"])
    blocked, spec = in_blocks(numbered, ["scene"], "t", back=0, ahead=1)
    follows = F.lead("token").over(spec).isNull() | ((F.col("next") == F.lead("token").over(spec)) & ~_ends(F.col("next")))
    rows = core_rows(blocked.withColumn("_follows", or_false(follows)))
    checks = rows.groupBy("scene").agg(
        F.min("_follows").alias("_chain"), F.max(F.when(F.col("t") == 0, F.col("token"))).alias("_first")
    )
    good = checks.where("_chain").join(scene_heads(poses), "scene").where(F.col("_first") == F.col("head"))
    return rows.drop("_follows").join(good.select("scene", F.lit(True).alias("linked")), "scene", "left").withColumn(
        "linked", or_false(F.col("linked"))
    )


# Frames of a scene that one task may hold, and that the short list may have, which is ranked by doubling.
SHORT_LIST = 100_000


def chain_order(poses: DataFrame, short_list: int = SHORT_LIST) -> DataFrame:
    """Exact link order: chains followed from the head of each scene.

    Tokens off the chain are not returned. A cycle ends the chain at its first repeated token, a link to
    a missing token or an end mark ends it there. Scenes without a head keep file order. Scenes of up to ``short_list`` frames are
    walked by :func:`walked_order`; of larger ones no task holds the whole, see :func:`split_order`.
    """
    if largest_group(poses, ["scene"]) <= short_list:
        return walked_order(poses)
    # Scenes without a name are no scene to join on; they keep file order.
    large = poses.groupBy("scene").count().where((F.col("count") > short_list) & F.col("scene").isNotNull()).select("scene")
    small = poses.where(F.col("scene").isNotNull()).join(large, "scene", "left_anti")
    unnamed = number_rows(poses.where(F.col("scene").isNull()), ["scene"], file_order(poses))
    return walked_order(small).unionByName(split_order(poses.join(large, "scene", "left_semi"), short_list)).unionByName(unnamed)


def walk(tokens: list[str | None], prevs: list[str | None], nexts: list[str | None]) -> list[int | None]:
    """The place of each frame of one scene, given in file order; None off the chain."""
    ends = (None, *END_MARKS)
    head = next((token for token, prev in zip(tokens, prevs) if prev in ends), None)
    if not head:
        return list(range(len(tokens)))
    # Of several rows with one token the largest link counts.
    onward: dict[str, str | None] = {}
    for token, link in zip(tokens, nexts):
        link, known = None if link in ends else link, onward.get(token)
        onward[token] = link if known is None or (link is not None and link > known) else known
    place: dict[str, int] = {}
    at: str | None = head
    while at is not None and at in onward and at not in place:
        place[at] = len(place)
        at = onward[at]
    return [place.get(token) for token in tokens]


def walked_order(poses: DataFrame) -> DataFrame:
    """Link order of scenes of which each fits one task: dealt by scene in one shuffle, and every chain walked where it lies."""
    columns = poses.columns
    dealt = poses.repartition("scene").sortWithinPartitions("scene", *file_order(poses))

    def ordered(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of whole scenes, one after the other."""
        rows = pa.Table.from_batches(parts)
        scenes, tokens, prevs, nexts = (rows[c].to_pylist() for c in ("scene", "token", "prev", "next"))
        places: list[int | None] = []
        for scene, size in ((s, sum(1 for _ in same)) for s, same in groupby(scenes)):
            part = slice(len(places), len(places) + size)
            # A scene without a name is none to follow links in.
            places += range(size) if scene is None else walk(tokens[part], prevs[part], nexts[part])
        out = rows.select(columns).append_column("t", pa.array(places, pa.int32()))
        yield from out.filter(out["t"].is_valid()).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: object = None
        for batch in batches:
            scenes = batch["scene"].to_pylist()
            starts = [n for n in range(len(scenes)) if scenes[n] != (scenes[n - 1] if n else last) or not (n or held)]
            if not scenes:
                continue
            last = scenes[-1]
            # Everything before the last scene that starts here is whole.
            if starts and (held or starts[-1]):
                yield from ordered([*held, batch.slice(0, starts[-1])])
                held = []
            held.append(batch.slice(starts[-1]) if starts else batch)
        if held:
            yield from ordered(held)

    return dealt.mapInArrow(run, poses.select("*", F.lit(0).alias("t")).schema)


def split_order(poses: DataFrame, short_list: int = SHORT_LIST) -> DataFrame:
    """Link order of scenes of any size, by equi-joins on (scene, token).

    Scenes in which several frames link to one token, which no whole recording has, are ranked by :func:`doubled_ranks`, all others by
    :func:`contracted_ranks`.
    """
    heads = scene_heads(poses)
    nodes = materialise(link_nodes(poses, heads))
    joined = nodes.groupBy("scene").agg(F.max("links").alias("links")).where("links > 1").select("scene")
    several = nodes.join(joined, "scene", "left_semi")
    single = nodes.join(joined, "scene", "left_anti")
    reached = contracted_ranks(single, heads.join(joined, "scene", "left_anti"), short_list)
    if not several.isEmpty():
        reached = reached.unionByName(doubled_ranks(hops(several), heads.join(joined, "scene", "left_semi")))
    headless = poses.join(heads, "scene", "left_anti")
    return poses.join(reached, ["scene", "token"]).unionByName(number_rows(headless, ["scene"], file_order(poses)))


def link_nodes(poses: DataFrame, heads: DataFrame) -> DataFrame:
    """One row per frame: ``next``, ``prev`` (a frame that links to it) at the distance ``dist``, and the number of ``links`` to it.

    Every frame sends its token to the one it links to. Links to a head are left out, since a chain ends where it would come back to
    its first token; those to missing tokens reach nobody.
    """
    onward = F.when(~_ends(F.col("next")), F.col("next"))
    own = poses.select("scene", "token", onward.alias("next"), F.lit(None).cast("string").alias("prev"))
    sent = own.where(F.col("next").isNotNull()).select(
        "scene", F.col("next").alias("token"), F.lit(None).cast("string").alias("next"), F.col("token").alias("prev"))
    met = own.withColumn("is_node", F.lit(True)).unionByName(sent.withColumn("is_node", F.lit(False))).groupBy("scene", "token").agg(
        F.max("next").alias("next"), F.min("prev").alias("prev"), F.count("prev").alias("links"), F.max("is_node").alias("is_node"))
    first = F.col("head").isNotNull() & F.col("head").eqNullSafe(F.col("token"))
    return met.where("is_node").join(heads, "scene").select(
        "scene", "token", F.when(F.col("next") != F.col("head"), F.col("next")).alias("next"), F.when(~first, F.col("prev")).alias("prev"), F.lit(1).alias("dist"),
        F.when(first, F.lit(0).cast("long")).otherwise(F.col("links")).alias("links"))


def hops(nodes: DataFrame) -> DataFrame:
    """Links between existing frames as (scene, src, to, step)."""
    links = nodes.where(F.col("next").isNotNull()).select("scene", F.col("token").alias("src"), F.col("next").alias("to"), F.lit(1).alias("step"))
    return links.join(nodes.select("scene", F.col("token").alias("to")), ["scene", "to"], "left_semi")


def doubled_ranks(links: DataFrame, heads: DataFrame) -> DataFrame:
    """Distance ``t`` of every token from the head by pointer doubling: log2(longest chain) rounds of equi-joins on (scene, token).

    After round r, ``reached`` holds the first 2^r tokens of each chain and a link the way over 2^r of them.
    """
    jump = materialise(links)
    reached = heads.select("scene", F.col("head").alias("token"), F.lit(0).alias("t"))
    longest, span = largest_group(jump, ["scene"]) + 1, 1
    while span < longest:
        further = reached.join(jump.withColumnRenamed("src", "token"), ["scene", "token"]).select(
            "scene", F.col("to").alias("token"), (F.col("t") + F.col("step")).alias("t")
        )
        reached = materialise(reached.unionByName(further).groupBy("scene", "token").agg(F.min("t").alias("t")))
        span *= 2
        if span < longest:
            second = jump.select("scene", F.col("src").alias("to"), F.col("to").alias("end"), F.col("step").alias("more"))
            jump = materialise(
                jump.join(second, ["scene", "to"]).select("scene", "src", F.col("end").alias("to"), (F.col("step") + F.col("more")).alias("step")))
            if jump.isEmpty():
                break
    return reached


def contracted_ranks(nodes: DataFrame, heads: DataFrame, short_list: int = SHORT_LIST) -> DataFrame:
    """Distance ``t`` of every token from the head by list contraction; the rows moved are linear in the frames.

    Each round takes out the frames whose hash is below those of both neighbours, about a third, which no two neighbours can be; every
    frame decides that alone, and one aggregate tells its neighbours of each other. What is left in the end is the short list;
    then the rounds are undone, each frame being as far as the one before it and the distance to that. ``nodes`` are written rows
    of scenes in which no two frames link to one token.
    """
    live, taken = nodes.select("scene", "token", "next", "prev", "dist"), []
    left = live.where(F.col("prev").isNotNull()).count()
    while left > short_list:
        def drawn(c: str) -> Column:
            return F.xxhash64(F.lit(len(taken)), "scene", c)

        lowest = (drawn("token") < drawn("prev")) & (F.col("next").isNull() | (drawn("token") < drawn("next")))
        rows = live.withColumn("out", or_false(F.col("prev").isNotNull() & lowest))
        gone, none = rows.where("out"), F.lit(None).cast("string")
        taken.append(gone.select("scene", "token", "prev", "dist"))
        # A frame that stays, or what one that goes tells the frame before it (its next) and the frame after it (its prev and distance).
        heard = (
            rows.where("NOT out").select("scene", "token", "next", "prev", "dist", F.lit(0).alias("more"), none.alias("new_prev"), none.alias("new_next"), F.lit(0).alias("cut"))
            .unionByName(gone.select("scene", F.col("prev").alias("token"), none.alias("next"), none.alias("prev"), F.lit(None).cast("int").alias("dist"),
                                     F.lit(0).alias("more"), none.alias("new_prev"), F.col("next").alias("new_next"), F.lit(1).alias("cut")))
            .unionByName(gone.where(F.col("next").isNotNull()).select(
                "scene", F.col("next").alias("token"), none.alias("next"), none.alias("prev"), F.lit(None).cast("int").alias("dist"),
                F.col("dist").alias("more"), F.col("prev").alias("new_prev"), none.alias("new_next"), F.lit(0).alias("cut")))
        )
        met = heard.groupBy("scene", "token").agg(
            *[F.max(c).alias(c) for c in ("next", "prev", "dist", "new_prev", "new_next", "cut")], F.sum("more").alias("more"))
        live = materialise(met.where(F.col("dist").isNotNull()).select(
            "scene", "token", F.when(F.col("cut") == 1, F.col("new_next")).otherwise(F.col("next")).alias("next"),
            F.coalesce("new_prev", "prev").alias("prev"), (F.col("dist") + F.col("more")).cast("int").alias("dist")))
        before, left = left, live.where(F.col("prev").isNotNull()).count()
        if left > 0.95 * before:
            # Only loops apart from every chain, too short to lose a frame.
            break
    # Distances are kept with the later frame of a link.
    links = live.where(F.col("prev").isNotNull()).select("scene", F.col("prev").alias("src"), F.col("token").alias("to"), F.col("dist").alias("step"))
    reached = doubled_ranks(links, heads)
    for gone in reversed(taken):
        back = reached.select("scene", F.col("token").alias("prev"), "t")
        reached = reached.unionByName(gone.join(back, ["scene", "prev"]).select("scene", "token", (F.col("t") + F.col("dist")).alias("t")))
        reached = materialise(reached)
    return reached


def temporal_order(poses: DataFrame) -> DataFrame:
    """Frames with their index ``t`` in link order.

    The usual case, links that agree with the time stamps, costs one sort; only the scenes where they
    disagree go through :func:`chain_order`, whose rows moved are linear in the frames too.
    """
    rows = materialise(stamp_ordered_scenes(poses))
    agree = rows.where("linked").drop("linked")
    odd = rows.where("NOT linked").select(*poses.columns)
    if odd.isEmpty():
        return agree
    return agree.unionByName(chain_order(odd).select(*agree.columns))
