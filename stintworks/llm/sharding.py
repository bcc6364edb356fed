"""Shards of near-equal bytes by Karmarkar-Karp differencing; groups of equal texts stay together.

Every item starts as a partial partition that holds its bytes in one of its parts and nothing in the
others. The two partial partitions with the largest spread (fullest minus emptiest part) are combined,
the fullest part of one with the emptiest of the other, until one is left. Its spread is the imbalance.

Differencing needs all its items at once, so their number is bounded whatever the input: a group
heavier than 1 / ``items`` of all bytes is an item of its own (there are at most ``items`` of them), and the
lighter groups are bundled by hash into ``items`` bundles, of that weight or less on average. The same rule
holds at every size. The result, at most ``2 * items`` rows, is broadcast to the documents: texts never move.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stintworks.llm.common import text_of
from stintworks.workspace import materialize

SHARDS = 16
ITEMS = 8192


def differencing(weights: list[int], parts: int) -> list[int]:
    """Part of every weight, by differencing of the partial partitions with the largest spread.

    Ties go by the place of a partial partition's first item, so the result depends on ``weights`` alone.
    """
    n = len(weights)
    if n == 0:
        return []
    # Sums of a partial partition, fullest part first. Only the sums of what is still in the heap are held.
    sums: list[np.ndarray | None] = []
    for w in weights:
        one = np.zeros(parts, np.int64)
        one[0] = w
        sums.append(one)
    first = list(range(n))
    merged: list[tuple[int, int, np.ndarray]] = []  # left, right, order of the combined parts
    heap = [(-int(w), i, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        sums[a] = sums[b] = None
        sums.append(both)
        first.append(min(first[a], first[b]))
        merged.append((a, b, order))
        heapq.heappush(heap, (int(both[-1] - both[0]), first[-1], len(sums) - 1))
    # From the last combination down: which final part each part of a partial partition went to.
    place: list[np.ndarray | None] = [None] * len(sums)
    place[-1] = np.arange(parts)
    for at in range(len(merged) - 1, -1, -1):
        a, b, order = merged[at]
        spot = np.empty(parts, np.int64)
        spot[order] = place[n + at]
        place[a], place[b], place[n + at] = spot, spot[::-1], None
    return [int(place[i][0]) for i in range(n)]


def group_key(text: Column) -> Column:
    """Equal texts have equal keys; texts whose keys collide merely share a shard."""
    return F.xxhash64(text)


def balance(groups: DataFrame, shards: int = SHARDS, items: int = ITEMS) -> tuple[DataFrame, Column]:
    """``item, shard, weight`` of all items, and the item of a row of ``groups`` by its columns ``key, weight``.

    ``groups`` has one row per group: ``key`` (long) and ``weight`` (long, positive). Stored.
    """
    total = groups.agg(F.sum("weight")).first()[0] or 0
    # A heavy group is named by its key, a bundle by its number; the flag keeps the two apart.
    heavy = F.col("weight") * F.lit(items) > F.lit(total)
    item = F.struct(heavy.alias("single"), F.when(heavy, F.col("key")).otherwise(F.pmod("key", F.lit(items))).alias("name"))
    weights = groups.groupBy(item.alias("item")).agg(F.sum("weight").alias("weight")).select("item.single", "item.name", "weight")

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [pa.Table.from_batches([b]) for b in batches]
        if not rows:
            return
        table = pa.concat_tables(rows).sort_by([("weight", "descending"), ("single", "ascending"), ("name", "ascending")])
        parts = differencing(table.column("weight").to_pylist(), shards)
        yield from table.append_column("shard", pa.array(parts, pa.int32())).combine_chunks().to_batches()

    placed = weights.repartition(1).mapInArrow(divide, "single boolean, name long, weight long, shard int")
    return materialize(placed, "shard-items"), item


def assign(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, items: int = ITEMS
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every document, one row per input row.

    Size is the UTF-8 bytes of the text plus one; NULL text counts as empty. Equal texts share a shard,
    repeated rows too, each with a slot of its own; slots of a shard run from 0 without a gap, in the order
    of the scan. A group that alone exceeds an even share fills its shard, and the others balance without
    it. NULL and repeated ids are ordinary. Extra columns are not read. An empty table gives an empty result.
    """
    text = text_of(text_col)
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        group_key(text).alias("key"),
        F.spark_partition_id().alias("split"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = materialize(rows, "shard-rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("weight"))
    placed = with_shard(rows, materialize(groups, "shard-groups"), shards, items)
    # Slots by split: each split numbers its own rows, counts of splits give where it begins.
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "shard", "split", "place"), "shard-placed")
    counts = placed.groupBy("shard", "split").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = counts.select("shard", "split", before.alias("begin"))
    within = F.row_number().over(W.partitionBy("shard", "split").orderBy("place")) - 1
    numbered = placed.withColumn("within", within).join(begins, ["shard", "split"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("within")).alias("slot"))


def with_shard(rows: DataFrame, groups: DataFrame, shards: int, items: int, key: str = "key", name: str = "shard") -> DataFrame:
    """``rows`` with the shard of their ``key``; a heavy group is found by its key, any other by its bundle."""
    found, _ = balance(groups, shards, items)
    # At most 2 * items rows of a few bytes each.
    single = F.broadcast(found.filter("single").select(F.col("name").alias("__name"), F.col("shard").alias("__single")))
    bundle = F.broadcast(found.filter("NOT single").select(F.col("name").alias("__bundle"), F.col("shard").alias("__shared")))
    joined = rows.join(single, F.col(key) == F.col("__name"), "left").join(
        bundle, F.pmod(F.col(key), F.lit(items)) == F.col("__bundle"), "left"
    )
    return joined.withColumn(name, F.coalesce("__single", "__shared")).drop("__name", "__single", "__bundle", "__shared")


def write_shards(
    docs: DataFrame, path: str, text_col: str = "text", shards: int = SHARDS, items: int = ITEMS, files_per_shard: int = 8
) -> None:
    """Write all columns of the documents below ``path/__shard=N``; a shard has ``files_per_shard`` files or fewer.

    Rows go to the files by a hash of the whole row, so a group of copies spreads over the files of its shard;
    only rows that agree in every column share one.
    """
    text = text_of(text_col)
    groups = docs.select(group_key(text).alias("key"), (F.octet_length(text).cast("long") + 1).alias("size"))
    groups = materialize(groups.groupBy("key").agg(F.sum("size").alias("weight")), "shard-groups")
    placed = with_shard(docs.withColumn("__key", group_key(text)), groups, shards, items, "__key", "__shard").drop("__key")
    file = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(files_per_shard))
    placed = placed.repartition(shards * files_per_shard, "__shard", file)
    placed.write.partitionBy("__shard").parquet(path)
