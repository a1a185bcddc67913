"""Ordered operators whose work splits inside a group, so one huge scene never sits in one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from clearway.session import materialise, written

# Rows of one group that a single task may sort.
GROUP_ROWS = 1_000_000
# Frames of one scene handled together by a sliding window.
BLOCK_FRAMES = 4096


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the biggest group; a map-side combined count."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def number_rows(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "t", limit: int = GROUP_ROWS) -> DataFrame:
    """Add the 0-based position of each row inside its group.

    Groups that fit one task use ``row_number``. If any group is larger, rows are range-partitioned on
    (keys, order), which splits a huge group over many tasks; each part is numbered on its own and
    shifted by the size of the parts before it. The order must be total within a group. Groups are counted
    first, which reads no more than the keys of a scan; hand over written rows where they are costly to make. Only a large group has
    the rows written.
    """
    if largest_group(df, keys) <= limit:
        spec = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(spec) - 1).cast("int"))
    # The part number becomes data here, so both uses below see the same split after a lost executor.
    parts = materialise(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        parts.groupBy(*keys, "_part").count()
        .withColumn("_shift", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    spec = Window.partitionBy(*keys, "_part").orderBy(*order)
    return (
        parts.join(shift, [*keys, "_part"])
        .withColumn(name, (F.row_number().over(spec) - 1 + F.col("_shift")).cast("int"))
        .drop("_part", "_shift")
    )


def numbered_in_order(df: DataFrame, order: Sequence[str | Column], places: dict[str, str | None], keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` and, for each name of ``places``, the 0-based position of a row in ``order`` among the rows that are equal in a class column, or all (None).

    Rows are shuffled once, by range of the order, for all positions. They are counted where they lie, by class, and written
    without the columns that only order them; each part is shifted by the counts of the parts before it. The order must be total. Classes are few: their counts
    in each part are broadcast.
    """
    classes = [c for c in dict.fromkeys(places.values()) if c is not None]
    columns = list(dict.fromkeys([*keep, *classes]))
    types = dict(df.dtypes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        by_class: dict[str, dict] = {c: {} for c in classes}
        for batch in batches:
            n = batch.num_rows
            found: dict[str | None, np.ndarray] = {None: np.arange(before, before + n)}
            before += n
            for c, so_far in by_class.items():
                coded = batch[c].dictionary_encode(null_encoding="encode")
                code, values = coded.indices.to_numpy(), coded.dictionary.to_pylist()
                sizes = np.bincount(code, minlength=len(values))
                at = np.empty(n, np.int64)
                at[np.argsort(code, kind="stable")] = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                found[c] = at + np.array([so_far.get(v, 0) for v in values], np.int64)[code] if n else at
                so_far.update({v: so_far.get(v, 0) + int(size) for v, size in zip(values, sizes)})
            local = [pa.array(found[c], pa.int64()) for c in places.values()]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in columns], pa.array(np.full(n, part, np.int32)), *local], names=[*columns, "_part", *places])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in columns), "_part int", *(f"`{p}` long" for p in places)])
    parts = written(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(count, schema), "numbered")
    out = parts
    for place, c in places.items():
        keys = [c] if c is not None else []
        earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = parts.groupBy(*keys, "_part").count()
        shift = sizes.select(*[F.col(k).alias("_class") for k in keys], F.col("_part").alias("_of"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_shift"))
        same = F.col("_part") == F.col("_of")
        if keys:
            same &= F.col(c).eqNullSafe(F.col("_class"))
        out = out.join(F.broadcast(shift), same).withColumn(place, F.col(place) + F.col("_shift")).drop("_of", "_class", "_shift")
    return out.select(*dict.fromkeys([*columns, *places]))


def running_totals(df: DataFrame, keys: list[str], order: list[str | Column], sums: list[str]) -> DataFrame:
    """Add ``before_<c>`` and ``all_<c>``, the sum of column c over the rows earlier in their group and over all of them, for each c of ``sums``.

    Prefix sums in three steps: rows are range-partitioned on (keys, order), every part is summed on its own, and parts are shifted by
    the totals of the parts before them. No group is ever sorted in one task; what is windowed in one task is one row per part. Rows
    with equal order must be added up first, or any of them may come first. The parts are written once, so a lost executor
    cannot deal them out differently.
    """
    parts = materialise(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    shifts = totals.select(
        *keys, "_part", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums],
        *[F.sum(f"_{c}").over(whole).alias(f"all_{c}") for c in sums])
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    shifted = [(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_{c}")).alias(f"before_{c}") for c in sums]
    return parts.join(shifts, [*keys, "_part"]).select(*df.columns, *shifted, *[f"all_{c}" for c in sums])


def in_blocks(df: DataFrame, keys: list[str], index: str, back: int, ahead: int, block: int = BLOCK_FRAMES) -> tuple[DataFrame, WindowSpec]:
    """Cut each group into blocks of consecutive ``index`` values with a margin on both sides.

    A window that looks at most ``back`` rows behind and ``ahead`` rows forward gives the same answer
    inside a block as over the whole group. Rows of the margin are copies: keep ``_core`` rows of the
    result. Returns the blocked rows and the window to use.
    """
    size = max(block, back + ahead, 1)
    own = F.floor(F.col(index) / size).cast("int")
    offset = F.col(index) - own * size
    copies = F.array(
        F.struct(own.alias("b"), F.lit(True).alias("core")),
        F.when(offset >= size - back, F.struct((own + 1).alias("b"), F.lit(False).alias("core"))),
        F.when(offset < ahead, F.struct((own - 1).alias("b"), F.lit(False).alias("core"))),
    )
    blocked = (
        df.withColumn("_copy", F.explode(copies))
        .where(F.col("_copy").isNotNull())
        .withColumn("_block", F.col("_copy.b"))
        .withColumn("_core", F.col("_copy.core"))
        .drop("_copy")
    )
    return blocked, Window.partitionBy(*keys, "_block").orderBy(index)


def core_rows(blocked: DataFrame) -> DataFrame:
    return blocked.where("_core").drop("_block", "_core")
