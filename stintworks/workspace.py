"""Intermediate tables in the folder the cluster shares.

A caller that stores results may open a ``scope``: on closing it removes what operators wrote inside.
Without a scope the tables stay until the application's folder is removed, so that lazy results remain readable.

Multi-pass operators (cohort moments, neighbour search, landing) write an intermediate result
once as Parquet instead of recomputing it. A written table survives lost executors, keeps column
pruning, and its file size lets Spark decide by itself whether a later join may broadcast it.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession


# Wide rows that a task sorts or folds at a time, so that they fit its memory.
TASK_ROWS = 250_000

_SCOPES: list[list[str]] = []
# Shuffle files of an action go when it ends, not when the driver's garbage is collected.
_FILES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables written inside, once the caller has stored its results.

    Scopes nest: a table belongs to the innermost. Frames that read its tables are of no use afterwards.
    """
    written: list[str] = []
    _SCOPES.append(written)
    try:
        yield
    finally:
        _SCOPES.remove(written)
        remove(spark, written)


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, object]) -> Iterator[None]:
    """Session settings for the actions run inside; what was set before comes back afterwards."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, str(value))
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def shuffles_end(spark: SparkSession) -> AbstractContextManager[None]:
    """The shuffle files of actions run inside go as soon as each of them ends.

    Every action plans its frame anew, so no later one would read them.
    """
    return settings(spark, _FILES_GO)


def remove(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        place = hadoop.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a private one is made only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    local = tempfile.mkdtemp(prefix="stintworks-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def new_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/stintworks/{app}/{name}-{uuid.uuid4().hex[:12]}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once and return a frame that reads it back; a ``path`` made outside a scope outlives that scope."""
    path = path or new_path(df.sparkSession, name)
    with shuffles_end(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, count: int, *keys: str) -> DataFrame:
    """``rows`` with equal keys in one task, about ``TASK_ROWS`` to each; ``count`` is how many there are at most.

    Adaptive execution joins partitions by their compressed size, which says little of wide rows that compress well: tasks
    of many such rows would spill. Where ``count`` is small they are left as they are.
    """
    spark = rows.sparkSession
    if count <= TASK_ROWS * spark.sparkContext.defaultParallelism:
        return rows
    return rows.repartition(max(math.ceil(count / TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
