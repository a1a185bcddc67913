"""Joins of a huge fact table with a smaller side."""

from __future__ import annotations

from pyspark.sql import DataFrame


def with_attrs(fact: DataFrame, frames: DataFrame, attrs: list[str]) -> DataFrame:
    """Frame attributes next to each child row.

    A fact table that already stores them (the layout to prefer: constant per frame, so nearly free
    in a columnar file) is returned as it is and never joined. The join itself is left to adaptive execution, which
    broadcasts a side that turns out small and splits skewed keys of the fact side.
    """
    missing = [a for a in attrs if a not in fact.columns]
    if not missing:
        return fact
    return fact.join(frames.select("scene", "t", *missing), ["scene", "t"])
