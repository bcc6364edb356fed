"""Stored tables that change together.

A store is a folder of Parquet parts and a manifest that names the parts which count. New parts are staged beside
the old ones, where no reader sees them; publishing a new manifest makes all of them count at once, of one table or of
several. A run that ends before it publishes leaves the store as it was. A keyed table is dealt over parts by a hash of
the key, so a merge reads and rewrites the parts that its updates fall in and no others.

The manifest has one entry per part: as many as a table has buckets or batches, whatever its rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stintworks.operators.merge import merge_by_key
from stintworks.workspace import settings, shuffles_end

BUCKETS = 64
PART = "__part"
# Wide rows that lie together by part: a task reads little of them, and writes so many parts side by side before it sorts by part.
WRITES = {"spark.sql.files.maxPartitionBytes": 8 << 20, "spark.sql.maxConcurrentOutputFileWriters": 16}
Changes = dict[str, dict[str, str]]  # table -> part -> folder below the root


class StaleVersion(RuntimeError):
    """The store was published to since the version that the changes were made from."""


class TableStore:
    """The tables below ``root``, a folder every executor can reach. Writers take turns; a stale one is refused."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, below: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, below: str) -> list[str]:
        path, files = self._path(below)
        return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []

    def version(self) -> int:
        """Number of the last published version, 0 before the first."""
        known = [int(n[1:-5]) for n in self._names("manifest") if n.startswith("v") and n.endswith(".json")]
        return max(known, default=0)

    def manifest(self, version: int | None = None) -> Changes:
        """Which folders count, by table and part."""
        version = self.version() if version is None else version
        if not version:
            return {}
        path = f"{self.root}/manifest/v{version:010d}.json"
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def read(self, table: str, schema: T.StructType | str, parts: Sequence[str] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a table (of some ``parts``), empty before the first publication."""
        folders = self.manifest(version).get(table, {})
        chosen = [f"{self.root}/{f}" for p, f in sorted(folders.items()) if parts is None or p in parts]
        if not chosen:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*chosen)

    def stage(self, table: str, rows: DataFrame, part: Column, together: bool = False) -> Changes:
        """Write ``rows`` beside the table, one folder per value of ``part``; nothing counts yet.

        ``together`` says that rows of a part lie together already, so they are written where they are.
        """
        folder = f"data/{table}/{uuid.uuid4().hex[:16]}"
        dealt = rows.withColumn(PART, part.cast("string"))
        # Rows of a part come together; one that outgrows a file is split by size.
        dealt = dealt if together else dealt.hint("rebalance", PART)
        with shuffles_end(self.spark), settings(self.spark, WRITES if together else {}):
            dealt.write.option("compression", "zstd").partitionBy(PART).parquet(f"{self.root}/{folder}")
        prefix = f"{PART}="
        return {table: {n.removeprefix(prefix): f"{folder}/{n}" for n in self._names(folder) if n.startswith(prefix)}}

    def staged(self, changes: Changes, table: str, schema: T.StructType | str) -> DataFrame:
        """The rows of staged parts, to be checked before they count."""
        folders = [f"{self.root}/{f}" for f in changes.get(table, {}).values()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def stage_merge(
        self, table: str, schema: T.StructType | str, updates: DataFrame, keys: Sequence[str], update_columns: Sequence[str],
        order: Sequence[str] | None = None, mode: str = "update", buckets: int = BUCKETS,
    ) -> Changes:
        """Stage the parts that a merge of ``updates`` by key changes; see ``merge_by_key``. ``updates`` should be stored."""
        touched = [r[0] for r in updates.select(_bucket(updates, keys, buckets).cast("string")).distinct().collect()]  # at most ``buckets``
        if not touched:
            return {table: {}}
        merged = merge_by_key(self.read(table, schema, touched), updates, keys, update_columns, order, mode)
        return self.stage(table, merged, _bucket(merged, keys, buckets))

    def publish(self, changes: Changes, since: int) -> int:
        """Make staged parts count, all at once. ``since`` is the version they were made from."""
        if self.version() != since:
            raise StaleVersion(f"version {self.version()} was published after {since}")
        tables = self.manifest(since)
        for table, parts in changes.items():
            tables[table] = {**tables.get(table, {}), **parts}
        draft, files = self._path(f"manifest/.{uuid.uuid4().hex}.draft")
        out = files.create(draft, False)
        try:
            out.write(bytearray(json.dumps(tables, sort_keys=True).encode()))
        finally:
            out.close()
        final, _ = self._path(f"manifest/v{since + 1:010d}.json")
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise StaleVersion(f"version {since + 1} was published by another writer")
        return since + 1


def _bucket(rows: DataFrame, keys: Sequence[str], buckets: int) -> Column:
    """Part of a row by its key columns alone, so that a row stays in its part however the rest of it changes."""
    # Keys compare across types that updates and table may differ in, so the hash is of their text.
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets))


def join_changes(*all_changes: Mapping[str, Mapping[str, str]]) -> Changes:
    """Changes of several tables as one."""
    out: Changes = {}
    for changes in all_changes:
        for table, parts in changes.items():
            out[table] = {**out.get(table, {}), **parts}
    return out
