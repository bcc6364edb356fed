"""Best-fit packing of tokenised documents under several capacities at once.

A sequence is a bin with three capacities: tokens, documents, and attention cost (the sum of squared
piece lengths, what attention inside documents costs). Pieces go in order of falling load; among the
open bins that still hold a piece under every constraint, the score chooses: ``dot`` takes the largest
weighted dot product of load and residual capacity, ``norm`` the smallest weighted norm of what
would remain. Pieces are dealt over shards by hash and each shard packs on its own; a shard holds
``shard_tokens`` tokens on average, so bins left open at its end are few, and its memory does not depend on the input.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stintworks.llm.common import text_of
from stintworks.workspace import materialize

CAPACITY = 2048
SEPARATOR = 0
SHARD_TOKENS = 1 << 24
# A piece counts as so many tokens at least when shards are sized: empty documents have memory too.
LEAST_TOKENS = 16
# Texts tokenised at once; a batch of longer texts holds fewer rows.
_BATCH = 256


def _encoder(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def tokenizer_files() -> dict[str, str]:
    """The vocabulary as JSON for ``tokenizers``, and the same vocabulary as ranks for ``tiktoken``."""
    import public_tokenizers

    return {
        "json_file": public_tokenizers.path("byte_bpe_50k.json"),
        "ranks_file": public_tokenizers.path("byte_bpe_50k.tiktoken"),
        "pattern": public_tokenizers.PATTERN,
    }


def make_encoder(json_file: str, ranks_file: str, pattern: str):
    """Text to ids as little-endian bytes. Equal to the JSON tokenizer: a text with one of its special
    strings goes through that, any other through the rank file, which gives the same ids several times faster."""
    import json

    with open(json_file, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f).get("added_tokens", []) if t.get("content")]
    fast = _encoder(ranks_file, pattern)
    slow = []

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(json_file))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(fast.encode_ordinary(text), "<u4").tobytes()

    return encode


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: only the first may be shorter than the capacity."""
    head = length % capacity or min(length, capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, length, capacity)]


def tokenize(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, files: dict | None = None, with_ids: bool = False
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids`` if asked for): the pieces of every document.

    A document is its ids and then the separator, so an empty or NULL text is one piece of one token.
    """
    files = files or tokenizer_files()
    columns = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    columns += [("ids", pa.list_(pa.int32()))] if with_ids else []
    schema = pa.schema(columns)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder(**files)
        end = np.array([SEPARATOR], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, _BATCH):
                batch = whole.slice(at, _BATCH)
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = encode(text.as_py()) + end
                    for number, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + length)]
                        row = [doc, number, start, length, zlib.crc32(part)]
                        rows.append(row + [np.frombuffer(part, "<i4")] if with_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(pieces, kinds)


class Bins:
    """Open bins of one shard: residual capacities as columns, so a piece meets all bins in one step."""

    def __init__(self, capacities: np.ndarray, weights: np.ndarray, rule: str):
        self.capacities, self.weights, self.rule = capacities, weights, rule
        self.left = np.empty((1024, len(capacities)))
        self.names = np.empty(1024, np.int64)
        self.n, self.made = 0, 0

    def place(self, load: np.ndarray) -> tuple[int, int]:
        """(bin, tokens already in it) for one piece."""
        left = self.left[: self.n]
        fits = np.flatnonzero((left >= load).all(axis=1))
        if len(fits):
            share, need = left[fits] / self.capacities, load / self.capacities
            if self.rule == "dot":
                best = fits[np.argmax(share @ (need * self.weights))]
            else:
                best = fits[np.argmin(((share - need) ** 2) @ self.weights)]
        else:
            if self.n == len(self.names):
                self.left = np.concatenate([self.left, np.empty_like(self.left)])
                self.names = np.concatenate([self.names, np.empty_like(self.names)])
            best, self.n = self.n, self.n + 1
            self.left[best], self.names[best] = self.capacities, self.made
            self.made += 1
        name, offset = int(self.names[best]), int(self.capacities[0] - self.left[best, 0])
        self.left[best] -= load
        return name, offset

    def close(self, least: np.ndarray) -> None:
        """Forget bins that can hold no further piece; ``least`` bounds every later load from below."""
        keep = np.flatnonzero((self.left[: self.n] >= least).all(axis=1))
        self.left[: len(keep)], self.names[: len(keep)] = self.left[keep], self.names[keep]
        self.n = len(keep)


def pack_shard(lengths: np.ndarray, capacities: np.ndarray, weights: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece of one shard, longest first."""
    lengths = np.asarray(lengths, np.int64)
    loads = np.stack([lengths, np.ones_like(lengths), lengths * lengths], axis=1).astype(float)
    bins = Bins(capacities.astype(float), weights, rule)
    names, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    least = loads.min(axis=0) if len(loads) else None
    for step, i in enumerate(np.argsort(-lengths, kind="stable")):
        names[i], offsets[i] = bins.place(loads[i])
        if step % 256 == 255:
            bins.close(least)
    return names, offsets


def pack(
    pieces: DataFrame,
    capacity: int = CAPACITY,
    most_documents: int | None = None,
    most_cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
    rule: str = "norm",
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored ``pieces`` (``doc_id, piece, start, length, ...``).

    Pieces longer than ``capacity``, or alone above ``most_cost``, raise: cut them before. Pieces as
    long as the capacity fill their sequences alone. Equal rows are separate pieces.
    """
    most_documents, most_cost = most_documents or capacity, most_cost or capacity * capacity
    total, longest = pieces.agg(F.sum(F.greatest("length", F.lit(LEAST_TOKENS))), F.max("length")).first()
    if longest and (longest > capacity or longest**2 > most_cost):
        raise ValueError(f"a piece of {longest} tokens fits no sequence")
    shards = int((total or 0) // shard_tokens + 1)
    limits, scale = np.array([capacity, most_documents, most_cost]), np.array(weights)
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    width = len(schema)

    def fill(key, table: pa.Table) -> pa.Table:
        # Order within a shard must not depend on how rows arrived.
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        names, offsets = pack_shard(table.column("length").to_numpy(), limits, scale, rule)
        table = table.append_column("sequence_id", pa.array((key[0].as_py() << 40) | names))
        return table.append_column("offset", pa.array(offsets)).select([f.name for f in schema][:width])

    # Rows that agree in all columns, as many as there may be, still differ in the place they are read at.
    row = F.pmod(F.monotonically_increasing_id(), F.lit(4096))
    shard = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", row), F.lit(shards))
    dealt = pieces.withColumn("__shard", shard)
    out = dealt.groupBy("__shard").applyInArrow(lambda key, t: fill(key, t.drop_columns(["__shard"])), schema)
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: dict | None = None, **limits) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its place. Empty tables give empty results; a
    repeated document is packed as often as it occurs."""
    pieces = materialize(tokenize(docs, id_col, text_col, limits.get("capacity", CAPACITY), files), "pack-pieces")
    return pack(pieces, **limits)


def sequences(placed: DataFrame, ids: str = "ids") -> DataFrame:
    """The packed sequences: ``sequence_id, ids, doc_ids, lengths`` from placed pieces that carry their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", F.col(ids).alias("ids"))))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths")
    )
