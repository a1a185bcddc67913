"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from clearway.session import new_shared_path, materialise as cut  # noqa: F401 - a reliable checkpoint, used by every iterative operator


# Bytes of the rows that go to a Python worker at once. Spark's own bound of 64 MB is held several times over by each running task: as rows, as buffers that
# double while they grow, and as the worker's copy.
BATCH_BYTES = 4 << 20
_BYTES_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session end after ``BATCH_BYTES``, whatever the size of a row; a smaller bound that was set stays."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BYTES_PER_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BYTES_PER_BATCH, f"{BATCH_BYTES}b")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just (id, text), with null texts as empty ones."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def per_process(key: Any, make: Callable[[], Any]) -> Any:
    """A value made once per Python worker and kept for its later tasks.

    Worker functions travel by value, so their module globals are new in every task; this survives them.
    """
    kept = sys.__dict__.setdefault("_clearway_llm", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def by_row(fn: Callable[..., tuple | None], columns: list[str], schema: pa.Schema, rows: int = 1024):
    """A ``mapInArrow`` function that calls ``fn`` on the values of ``columns`` of each row.

    Batches are cut to ``rows`` rows, so that many long texts are never Python objects at the same time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                out = [fn(*values) for values in zip(*(part[c].to_pylist() for c in columns))]
                yield record_batch(out, schema)

    return run


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder. Unlike a checkpoint it has the size of what was written; a checkpoint keeps the estimate of the
    plan it came from, a product over all joins, which long chains of joins square with every round.
    """
    path = new_shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spark_schema(schema: pa.Schema) -> StructType:
    return from_arrow_schema(schema)


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of about ``rows`` labelled documents, chosen by a hash of the id; all if there are fewer.

    Of contradicting labels of one id the more frequent counts, 1 in a tie; null ids and labels are left out. The chosen labels, never more
    than ``rows`` and a chance excess, are broadcast, so the texts are not shuffled.
    """
    known = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("double").alias("label"))
        .dropna().groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    )
    parts = 1 << 30
    share = min(parts, math.ceil(parts * rows / max(1, known.count())))
    chosen = known.where(F.pmod(F.xxhash64("id", F.lit(label)), F.lit(parts)) < share)
    return id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "id")
