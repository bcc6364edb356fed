"""Exact dedup over an extendible-hash index on shared files.

The address of a text is a hash of its digest; the first bits of the address choose a directory slot.
Starting from one bucket, a bucket that would hold more than ``bucket_bytes`` splits and the directory
doubles, until every bucket fits or the directory has its largest size. A bucket is a range of
addresses; one task owns it, chains entries whose addresses collide, and writes it to the shared
folder. Equal texts meet in a grouping on the whole text, so bytes are compared and not only digests,
and a group of copies shrinks to one row per task before it is shuffled.

Everything is DataFrame code; the directory has at most ``2 ** max_depth`` slots at any input size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from stintworks.llm.common import join_groups, lower_az, text_of
from stintworks.workspace import materialize

BUCKET_BYTES = 32 << 20
MAX_DEPTH = 20


def digests(docs: DataFrame, id_col: str, text_col: str, hash_bits: int, digest_chars: int) -> DataFrame:
    """Normalised text with its digest and address; ``key`` is the part of the digest that identifies it."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), lower_az(text_of(text_col)).alias("norm"))
    rows = rows.withColumn("text_sha256", F.sha2("norm", 256)).withColumn("key", F.substring("text_sha256", 1, digest_chars))
    return rows.withColumn("address", F.shiftrightunsigned(F.xxhash64("key"), 64 - hash_bits))


def directory(keys: DataFrame, hash_bits: int, bucket_bytes: int, max_depth: int) -> tuple[DataFrame, int]:
    """Slots and the bucket each points to, and the depth of the directory.

    ``keys`` has one row per distinct text: ``address``, ``n_bytes``. All doublings are worked out at
    once: a node of the prefix tree that is too full has split, and a slot belongs to the node below
    its deepest split. Buckets deeper than the last doubling do not split further; their chains grow.
    """
    total = keys.agg(F.sum("n_bytes")).first()[0] or 0
    doublings = (total // bucket_bytes).bit_length() + 5  # some buckets are fuller than the mean
    depth = max(1, min(max_depth, hash_bits, doublings))
    slots = keys.groupBy(F.shiftrightunsigned("address", hash_bits - depth).alias("slot")).agg(F.sum("n_bytes").alias("n_bytes"))
    nodes = slots.select(
        "slot", "n_bytes", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("level")
    ).withColumn("prefix", F.expr(f"shiftright(slot, {depth} - level)"))
    split = nodes.groupBy("level", "prefix").agg(F.sum("n_bytes").alias("load")).filter(F.col("load") > bucket_bytes)
    local = nodes.join(split, ["level", "prefix"]).groupBy("slot").agg((F.max("level") + 1).alias("local_depth"))
    table = slots.join(local, "slot", "left").select(
        "slot", F.coalesce("local_depth", F.lit(0)).alias("local_depth")
    )
    # Root 1, children 2n and 2n + 1: the number of a bucket tells its depth and its range.
    bucket = F.expr(f"shiftleft(1L, local_depth) + shiftright(slot, {depth} - local_depth)")
    return table.withColumn("bucket", bucket), depth


def build_index(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    max_depth: int = MAX_DEPTH,
    hash_bits: int = 63,
    digest_chars: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """The stored index (one row per distinct text) and the stored digest of every document."""
    rows = digests(docs, id_col, text_col, hash_bits, digest_chars)
    seen = materialize(
        rows.select("doc_id", "address", "key", "text_sha256", F.octet_length("norm").cast("long").alias("n_bytes")), "dedup-digests"
    )
    keys = seen.groupBy("address", "key").agg(F.max("n_bytes").alias("n_bytes"))
    slots, depth = directory(keys, hash_bits, bucket_bytes, max_depth)
    slots = materialize(slots, "dedup-directory")
    placed = rows.withColumn("slot", F.shiftrightunsigned("address", hash_bits - depth)).join(
        F.broadcast(slots.select("slot", "bucket")), "slot"  # at most 2 ** max_depth rows
    )
    entries = placed.groupBy("bucket", "address", "norm").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.first("key").alias("key")
    )
    owned = entries.select(
        "bucket", "address", "key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"
    ).repartition("bucket")
    chain = W.partitionBy("bucket", "address").orderBy("key", "text_sha256", "keep_id")
    return materialize(owned.withColumn("chain", F.row_number().over(chain)), "dedup-index"), seen


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index) -> DataFrame:
    """Which documents are equal after lower-casing A-Z, and which one of each group stays.

    Result: ``doc_id, keep_id, group_size, kept, text_sha256``, one row per input row. The row with the
    largest id of a group stays. NULL text counts as empty and forms a group with empty texts; a NULL
    id never wins over another id. Of rows that repeat both id and text, one is kept. Extra columns
    are not read. An empty table gives an empty result.
    """
    entries, seen = build_index(docs, id_col, text_col, **index)
    found = entries.select("address", "key", "keep_id", "group_size")
    clash = found.groupBy("address", "key").count().filter("count > 1").select("address", "key")
    if clash.isEmpty():  # no two texts share a digest
        looked_up = join_groups(seen, found, ["address", "key"], "group_size")
    else:
        clash = materialize(clash, "dedup-clash")
        sure = seen.join(clash, ["address", "key"], "left_anti")
        looked_up = join_groups(sure, found.join(clash, ["address", "key"], "left_anti"), ["address", "key"], "group_size")
        texts = digests(docs, id_col, text_col, index.get("hash_bits", 63), index.get("digest_chars", 64))
        texts = texts.join(clash, ["address", "key"], "left_semi")
        chains = texts.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        looked_up = looked_up.unionByName(join_groups(texts, chains, ["norm"], "group_size"), allowMissingColumns=True)
    once = W.partitionBy("address", "text_sha256", "doc_id").orderBy("group_size")
    return looked_up.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(once) == 1)).alias("kept"),
        "text_sha256",
    )


def keep_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index) -> DataFrame:
    """The documents that stay, with all their columns."""
    kept = exact_dedup(docs, id_col, text_col, **index).filter("kept").select(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")
    )
    rows = docs.withColumn("__text_sha", F.sha2(lower_az(text_of(text_col)), 256))
    same = rows[f"`{id_col}`"].eqNullSafe(kept["__id"]) & (rows["__text_sha"] == kept["__sha"])
    return rows.join(kept, same, "left_semi").dropDuplicates([id_col, "__text_sha"]).drop("__text_sha")
