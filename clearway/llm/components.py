"""Connected components of a link table, for groups of near-duplicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from clearway.llm.common import cut as checkpointed


def _lowest(links: DataFrame) -> DataFrame:
    """(a, low): the smallest node among ``a`` and its partners. Combines map-side, so a hub is no hot key."""
    return links.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))


def _summary(links: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(links.agg(F.count("*"), F.sum(mixed)).first())


def components(links: DataFrame, cut: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b: long); the component is its smallest reachable node.

    Alternates large-star and small-star steps until the links are stars. A step sends each link to the smallest node its end
    knows, found by a combining aggregate; the join back is on a hub's own links, which adaptive execution splits, as both sides come from
    written tables. Rounds grow with the logarithm of the longest chain. Links of a node to itself are dropped; repeated links do no harm.
    """
    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _summary(links)
    while before[0]:
        # Large star: all larger partners of a node move to the smallest node it knows.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(_lowest(both))
        links = cut(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        # Small star: a node and its smaller partners move to the smallest of them.
        low = cut(_lowest(links))
        moved = links.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b")).where("a <> b")
        links = cut(moved.distinct())
        after = _summary(links)
        if after == before:
            break
        before = after
    # Stars: every link leads to the centre.
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
