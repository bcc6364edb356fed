"""Near-duplicate groups by MinHash with sequential Bayesian verification.

Documents with one and the same shingle set form a class; everything below works on classes. Bands of the
signature deal classes to buckets. Candidates are compared hash by hash in batches: given the
matches so far, a pair goes as soon as its similarity reaches the threshold with less than the chosen
miss probability. Only pairs that survive all batches are verified, on full shingle sets.

No bucket is expanded into all its pairs. First every class meets the smallest class of each of its
buckets; the links found give components. Classes of one component need no further comparison, so a bucket of
near copies is done. Where classes of different components still share a bucket, blocks of them are
compared inside tasks, on signatures first and on full sets then, and a block sends on only the links that
join its components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stintworks.llm.common import join_groups, text_of
from stintworks.llm.fingerprints import WordHashes, shingle_hashes
from stintworks.workspace import materialize

SHINGLE = 5
PERCENT = 80
# Hashes in a band; the number of bands follows from threshold and miss probability.
ROWS = 4
MISS = 1e-7
# Hashes compared at a time, classes and bytes of full sets that one block holds, partners of a class that share a task.
BATCH = 16
BLOCK = 4096
BLOCK_BYTES = 64 << 20
PARTNERS = 512
# Shingles hashed at once.
_CHUNK = 1 << 17


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """So many bands that a pair at the threshold shares none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows)) if percent < 100 else 1


@lru_cache(maxsize=None)
def least_matches(compared: int, percent: int, miss: float) -> int:
    """Fewest matches of ``compared`` hashes for which P(similarity >= threshold | matches) is at least ``miss``.

    With a uniform prior the posterior is a beta distribution, whose tail is a binomial sum.
    """
    t, tail = percent / 100, 0.0
    for matches in range(compared + 1):
        tail += math.comb(compared + 1, matches) * t**matches * (1 - t) ** (compared + 1 - matches)
        if tail >= miss:
            return matches
    return compared


def survives(a: np.ndarray, b: np.ndarray, percent: int, miss: float, batch: int = BATCH) -> np.ndarray:
    """Which row pairs of two signature matrices pass every batch; pruned pairs are not compared further."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for start in range(0, a.shape[1], batch):
        end = min(start + batch, a.shape[1])
        matches[alive] += (a[alive, start:end] == b[alive, start:end]).sum(axis=1)
        alive = alive[matches[alive] >= least_matches(end, percent, miss)]
    kept = np.zeros(len(a), bool)
    kept[alive] = True
    return kept


class Sketcher:
    def __init__(self, size: int, hashes: int):
        self.size, self.words = size, WordHashes()
        rng = np.random.default_rng(17)
        self.factors = rng.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.masks = rng.integers(0, 1 << 63, hashes, dtype=np.uint64)

    def shingles(self, text: str) -> np.ndarray:
        """The set: sorted distinct hashes."""
        return np.unique(shingle_hashes(text, self.size, self.words))

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """(sets, hashes) minima; no set may be empty."""
        joined = np.concatenate(sets)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        out = np.empty((len(sets), len(self.factors)), np.uint32)
        work = np.empty_like(joined)
        for i, (factor, mask) in enumerate(zip(self.factors, self.masks)):
            np.bitwise_xor(joined, mask, out=work)
            np.multiply(work, factor, out=work)
            out[:, i] = np.minimum.reduceat(work, starts) >> np.uint64(32)
        return out


def _name(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _mark(text: Column) -> Column:
    """Names a text; rows that agree in id and mark differ at most in other columns."""
    return F.unhex(F.sha2(text, 256))


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int, hashes: int, marked: bool = False) -> DataFrame:
    """``doc_id, n_shingles, node, sig``; ``node`` names the shingle set, NULL for an empty one. With ``marked`` also ``mark``."""
    fields = ["doc_id", "n_shingles", "node", "sig", *["mark"] * marked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Sketcher(size, hashes)
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                sets, held = [], 0
                while at + len(sets) < whole.num_rows and (not sets or held < _CHUNK):
                    sets.append(maker.shingles(whole.column(1)[at + len(sets)].as_py()))
                    held += len(sets[-1])
                full = [i for i, s in enumerate(sets) if len(s)]
                nodes, sigs = [None] * len(sets), [None] * len(sets)
                if full:
                    for i, sig in zip(full, maker.signatures([sets[i] for i in full])):
                        nodes[i], sigs[i] = _name(sets[i]), sig.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [whole.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary())]
                    + [c.slice(at, len(sets)) for c in whole.columns[2:]],
                    names=fields,
                )
                at += len(sets)

    text = text_of(text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), *[_mark(text).alias("mark")] * marked)
    return rows.mapInArrow(run, "doc_id long, n_shingles long, node binary, sig binary" + ", mark binary" * marked)


def banded(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    """``node, band, bucket``: one row per class and band."""
    width = 4 * rows
    parts = [F.xxhash64(F.lit(b), F.substring("sig", 1 + b * width, width)) for b in range(bands)]
    return nodes.select("node", F.posexplode(F.array(*parts)).alias("band", "bucket"))


def bayes(pairs: DataFrame, nodes: DataFrame, percent: int, miss: float) -> DataFrame:
    """The ``pairs`` (``a, b``) that signatures do not rule out."""
    side = nodes.select("node", "n_shingles", "sig")
    both = pairs.join(side.toDF("a", "n_a", "sig_a"), "a").join(side.toDF("b", "n_b", "sig_b"), "b")
    both = both.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array(survives(a, b, percent, miss)))

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a binary, b binary")


def _partners(rows: list[tuple], bands: int, percent: int, miss: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each class of a block, the later ones of other components that signatures do not rule out.

    ``rows`` are (bucket, band, left block, right block, own block, node, label, n, sig, ...). Of two different
    blocks, classes of the left meet those of the right. A pair is looked at in the first band that it shares.
    """
    band, left, right = rows[0][1:4]
    sig = np.frombuffer(b"".join(r[8] for r in rows), np.uint32).reshape(len(rows), -1)
    n = np.array([r[7] for r in rows])
    names = {label: i for i, label in enumerate(dict.fromkeys(r[6] for r in rows))}
    label = np.array([names[r[6]] for r in rows])
    own = np.array([r[4] for r in rows])
    for i in np.flatnonzero(own == left):
        other = np.flatnonzero((own == right) & (label != label[i]))
        if left == right:
            other = other[other > i]
        other = other[100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i])]
        if len(other):
            same = (sig[other] == sig[i]).reshape(len(other), bands, -1).all(axis=2)
            other = other[same.argmax(axis=1) == band]
        if len(other):
            other = other[survives(np.repeat(sig[i : i + 1], len(other), axis=0), sig[other], percent, miss)]
            if len(other):
                yield int(i), other


def _links(rows: list[tuple], bands: int, percent: int, miss: float) -> list[tuple[bytes, bytes]]:
    """Verified links between the components of a block, as many as it takes to join them.

    The last field of a row is its full set. A class is marked in the vocabulary of the block and
    all its partners are counted against the marks at once.
    """
    sets = [np.frombuffer(r[9], np.uint64) for r in rows]
    vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    mark = np.zeros(len(vocabulary), np.int64)
    names = {label: i for i, label in enumerate(dict.fromkeys(r[6] for r in rows))}
    parent = list(range(len(names)))
    label = [names[r[6]] for r in rows]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for i, others in _partners(rows, bands, percent, miss):
        others = [j for j in others if root(label[j]) != root(label[i])]
        if not others:
            continue
        own = ids[starts[i] : starts[i + 1]]
        mark[own] = 1
        sizes = np.array([len(sets[j]) for j in others])
        hits = mark[np.concatenate([ids[starts[j] : starts[j + 1]] for j in others])]
        common = np.add.reduceat(hits, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        mark[own] = 0
        for j in np.array(others)[100 * common >= percent * (sizes + len(own) - common)]:
            if root(label[j]) != root(label[i]):
                parent[root(label[j])] = root(label[i])
                found.append((min(rows[i][5], rows[j][5]), max(rows[i][5], rows[j][5])))
    return found


def _per_block(batches: Iterator[pa.RecordBatch], key: int, work) -> Iterator[tuple]:
    """What ``work`` makes of each run of rows that agree in their first ``key`` fields; one run is held at a time."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:key] != held[0][:key]:
                yield from work(held)
                held = []
            held.append(row)
    if held:
        yield from work(held)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


_KEY = ["bucket", "band", "left", "right"]


def open_blocks(buckets: DataFrame, nodes: DataFrame, labels: DataFrame, bands: int, percent: int, miss: float) -> DataFrame:
    """The classes that may be linked to another component in a bucket they share, block by block.

    A bucket of more classes or set bytes than one block holds is dealt to several, and every pair of
    its blocks is a block of its own.
    """
    known = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = materialize(known.join(nodes.select("node", "n_shingles"), "node"), "near-labelled")
    # Two classes have met as center and partner; only larger buckets hold pairs that have not.
    open_ = known.groupBy("band", "bucket").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("weight"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(8 * F.col("weight") / BLOCK_BYTES)).cast("int")
    open_ = open_.filter("size > 2 AND low <> high").select("band", "bucket", "size", blocks.alias("blocks"))
    rows = known.join(open_, ["band", "bucket"]).join(nodes.select("node", "sig"), "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "bucket", "band", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "own", "node", "label", "n_shingles", "sig"
    )
    schema = pa.schema(
        [("bucket", pa.int64()), ("band", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("own", pa.int32()), ("node", pa.binary()), ("label", pa.binary()), ("n_shingles", pa.int64()), ("sig", pa.binary())]
    )

    def reach(held: list[tuple]) -> list[tuple]:
        at = {k for i, others in _partners(held, bands, percent, miss) for k in (i, *others.tolist())}
        return [held[k] for k in sorted(at)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(_per_block(batches, len(_KEY), reach), schema)

    dealt = rows.repartition(*_KEY).sortWithinPartitions(*_KEY, "node")
    return dealt.mapInArrow(run, "bucket long, band int, left int, right int, own int, node binary, label binary, n_shingles long, sig binary")


def links_across(blocks: DataFrame, sets: DataFrame, bands: int, percent: int, miss: float) -> DataFrame:
    """Links between components, verified on full sets inside the blocks."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(_per_block(batches, len(_KEY), lambda held: _links(held, bands, percent, miss)), schema)

    rows = blocks.join(sets.select("node", "shingles"), "node").select(*blocks.columns, "shingles")
    return rows.repartition(*_KEY).sortWithinPartitions(*_KEY, "node").mapInArrow(run, "a binary, b binary")


def full_sets(stake: DataFrame, docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``node, shingles`` (packed, sorted) of the classes in ``stake``, made again from their texts."""
    stake = nodes.join(stake, "node", "left_semi").select("node", F.col("low").alias("doc_id"))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    texts = texts.join(stake.select(F.col("doc_id").alias("__id")).distinct(), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Sketcher(size, 1)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                sets = [maker.shingles(t) for t in whole.column(0).slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_name(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"]
                )

    sets = texts.select("text").mapInArrow(run, "node binary, shingles binary")
    return materialize(sets.join(stake.select("node"), "node", "left_semi").dropDuplicates(["node"]), "near-sets")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` whose full shingle sets reach the threshold.

    A class with many partners is copied for every ``PARTNERS`` of them.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("parts"))
    left = sets.join(parts, sets["node"] == parts["a"]).select("a", F.col("shingles").alias("set_a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts").cast("int"))
    right = right.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort(kind="stable")  # merges the two sorted runs
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            if batch.num_rows:
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return right.join(left, ["a", "part"]).select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that each linked node reaches, by alternating large and small stars.

    A round points nodes at the smallest neighbour; it ends when no edge changes. Hubs are split by the join.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "near-edges")

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialize(small.filter("u <> v").distinct(), "near-edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, rows: int, miss: float, marked: bool = False) -> tuple[DataFrame, DataFrame]:
    """The stored sketch and, for each class, ``node, component_id, size``.

    With ``marked`` classes also have ``first``, the id and mark of the row that stands for the component, and
    ``members``, the rows of the component.
    """
    bands = bands_for(percent, rows, miss)
    seen = materialize(sketch(docs, id_col, text_col, size, bands * rows, marked), "near-sketch")
    # The smallest id, of equal ids the smallest mark; NULL ids come last.
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), *["doc_id", *["mark"] * marked])
    nodes = seen.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("size"), F.max("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"),
        *[F.min(first).alias("first")] * marked,
    )
    nodes = materialize(nodes, "near-nodes")
    every = banded(nodes, bands, rows)
    centers = every.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("bucket_size"), F.min("node").alias("a")).filter("bucket_size > 1")
    # Most classes are alone in their buckets and go here; Spark splits a crowded bucket when it joins.
    buckets = materialize(every.join(centers, ["band", "bucket"]), "near-buckets")
    stars = buckets.filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    survivors = materialize(bayes(stars, nodes, percent, miss), "near-stars")
    stake = survivors.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = materialize(verify(survivors, full_sets(stake, docs, nodes, id_col, text_col, size), percent), "near-links")
    labels = materialize(components(links), "near-labels")
    blocks = materialize(open_blocks(buckets.select("node", "band", "bucket"), nodes, labels, bands, percent, miss), "near-blocks")
    if not blocks.isEmpty():
        sets = full_sets(blocks.select("node").distinct(), docs, nodes, id_col, text_col, size)
        more = materialize(links_across(blocks, sets, bands, percent, miss), "near-across")
        labels = components(links.unionByName(more))
    stands = [F.min("first").alias("first"), F.sum("size").alias("members")] if marked else []
    found = nodes.select("node", "low", "size", *["first"] * marked).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = found.groupBy("label").agg(F.min("low").alias("component_id"), *stands)
    found = found.select("node", "size", "label").join(lowest, "label").drop("label")
    return seen, materialize(found, "near-components")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    percent: int = PERCENT,
    rows: int = ROWS,
    miss: float = MISS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` with one row per input row.

    Two documents are linked if their sets of word shingles have ``100 * intersection >= percent * union``.
    ``component_id`` is the smallest id reachable by links; the document that has it stays. A document
    with fewer than ``size`` words has one shingle; without words (or NULL text) it has none and no links, and stays.
    Of rows that repeat id and set all carry the same answer. NULL ids count as larger than any id. Extra columns are
    not read; an empty table gives an empty result.
    """
    seen, found = _grouped(docs, id_col, text_col, size, percent, rows, miss)
    listed = join_groups(seen.filter("node IS NOT NULL"), found, ["node"], "size").select("doc_id", "n_shingles", "component_id")
    alone = seen.filter("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return listed.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    percent: int = PERCENT,
    rows: int = ROWS,
    miss: float = MISS,
) -> DataFrame:
    """The documents that stay, with all their columns: one row of every component, and all rows without words.

    The row with the smallest id stays, a NULL id only if no member has one; of members that share that id the text
    with the smallest SHA-256, and of rows that agree in id and text the first as JSON. An id may be NULL or name
    different texts: what happens to one of its rows does not touch the others.
    """
    seen, found = _grouped(docs, id_col, text_col, size, percent, rows, miss, marked=True)
    found = found.filter("members > 1").select("node", "size", "first")
    members = join_groups(seen.filter("node IS NOT NULL").select("doc_id", "node", "mark"), found, ["node"], "size")
    chosen = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    pairs = members.groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), chosen.alias("chosen")).agg(F.count(F.lit(1)).alias("rows"))
    pairs = materialize(pairs.filter("NOT chosen OR rows > 1"), "near-pairs")
    gone, again = pairs.filter("NOT chosen"), pairs.filter("chosen")

    def same(left: DataFrame, right: DataFrame) -> Column:
        return left["__own_id"].eqNullSafe(right["__id"]) & (left["__own_mark"] == right["__mark"])

    columns = [F.col(f"`{c}`") for c in docs.columns]
    known = docs.withColumns({"__own_id": F.col(f"`{id_col}`").cast("long"), "__own_mark": _mark(text_of(text_col))})
    kept = known.join(gone, same(known, gone), "left_anti")
    if again.isEmpty():
        return kept.select(*columns)
    repeated = kept.join(again, same(kept, again), "left_semi").groupBy("__own_id", "__own_mark")
    once = repeated.agg(F.min_by(F.struct(*columns), F.to_json(F.struct(*columns))).alias("row")).select("row.*")
    return kept.join(again, same(kept, again), "left_anti").select(*columns).unionByName(once)
