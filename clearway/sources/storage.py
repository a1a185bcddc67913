"""Files opened inside tasks, on any storage that executors share."""

from __future__ import annotations

import re

import pyarrow.fs as pa_fs
from pyspark.sql import SparkSession


def open_store(root: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    uri = root.rstrip("/") or "/"
    if re.match("^[A-Za-z][A-Za-z0-9+.-]*:/", uri):
        # One slash or three after the name of local files; other names for the same object store.
        uri = re.sub("^file:/+", "file:///", uri)
        uri = re.sub("^s3[an]://", "s3://", uri)
        return pa_fs.FileSystem.from_uri(uri)
    return pa_fs.LocalFileSystem(), uri


def many_tasks(spark: SparkSession) -> int:
    """Tasks for rows that are small but costly to work on, so that adaptive execution would put them into a few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
