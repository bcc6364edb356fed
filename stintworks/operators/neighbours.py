"""Exact nearest neighbours within cohorts, for one target or for every entity.

Candidates are laid out along a search tree per cohort: boxes on principal axes, fitted on a bounded sample of
the cohort, with every row placed. Subtrees of at most ``PART_ROWS`` rows are parts; a task sees one bounded block, a slice of
queries and a part, walks the part's leaves and returns at most k rows per query. Where a cohort has several parts, a target
first searches the one it falls in, which gives a distance no true neighbour can exceed, then in rounds the next
nearest parts that may still hold one. So no pair list is ever formed and no task holds more than a part.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from stintworks.functions.blocks import (
    DECIMALS, METRICS, nearer_in_block, nearest_in_block, points_of as _points, squared_limit as _squared_limit,
)
from stintworks.functions.boxes import AXES, Nodes, Splits, box_coordinates, fit_splits, principal_axes
from stintworks.workspace import materialize, new_path, remove, scope

# Rows of a leaf of the tree, and targets that descend a tree in one task at a time.
CHUNK_ROWS = 16384
QUERY_ROWS = 4096
# Rows of a part and queries of a slice: the size of the block a task holds.
PART_ROWS = 1 << 18
SLICE_ROWS = 1 << 17
# A tree has at most 2**14 leaves and is fitted on about so many rows a leaf, 2**19 in all; beyond, leaves hold several chunks.
MAX_DEPTH = 14
SAMPLE_ROWS_PER_LEAF = 32
# Rows that are placed, and targets that descend the tree, in one task at a time.
_PLACED_ROWS = 100_000
# Parts a target searches in a round: its own, then a few, then all that its bound leaves.
_ROUNDS = (8, None)
_CHUNK = ["cohort", "part", "chunk"]
# Wider than one unit of the compared precision, so that rounding never hides a neighbour.
_SLACK = 2e-6


def pair_scores(a: Column, b: Column, dims: int) -> dict[str, Column]:
    """The three scores of two vectors, summed in feature order."""
    gaps = [a[i] - b[i] for i in range(dims)]

    def total(terms: list[Column]) -> Column:
        return sum(terms[1:], terms[0])

    norms = F.sqrt(total([a[i] * a[i] for i in range(dims)])) * F.sqrt(total([b[i] * b[i] for i in range(dims)]))
    dot = total([a[i] * b[i] for i in range(dims)])
    return {
        "euclidean": F.sqrt(total([g * g for g in gaps])),
        "manhattan": total([F.abs(g) for g in gaps]),
        "cosine": F.when(norms == 0, F.lit(0.0)).otherwise(dot / norms),
    }


@dataclass
class Index:
    """Candidate rows with their leaf (``cell``), part and chunk, one row per leaf and per part with its box, and the axes
    of each cohort. ``whole``: every cohort is one part."""

    rows: DataFrame
    cells: DataFrame
    parts: DataFrame
    whole: bool
    axes: DataFrame | None
    metric: str
    dims: int

    @property
    def single(self) -> bool:
        """Is every cohort one block, so that there is no tree?"""
        return self.axes is None

    def under(self, metric: str) -> Index:
        """The same layout searched by another distance; a tree serves the distances over its coordinates only."""
        if not self.single and (metric == "cosine") != (self.metric == "cosine"):
            raise ValueError("cosine has coordinates of its own")
        return replace(self, metric=metric)


def points_of(vectors: pd.Series, metric: str) -> np.ndarray:
    return _points(np.stack(vectors.to_numpy()).astype(float), metric)


def _one_per_slice(rows: DataFrame, per: DataFrame, size: int, by: list[str], copied: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a ``slice`` of about ``size`` rows within their cohort, and ``copied`` once for every slice.

    ``per`` has ``cohort, rows``: how many rows of each cohort there are.
    """
    slices = per.select("cohort", F.ceil(F.col("rows") / size).cast("int").alias("slices"))
    dealt = rows.join(slices, "cohort").withColumn("slice", F.pmod(F.xxhash64(*by), F.col("slices")).cast("int")).drop("slices")
    copies = copied.join(slices, "cohort").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    return dealt, copies


def _fitted(rows: DataFrame, plan: DataFrame, metric: str) -> DataFrame:
    """``cohort, axes, nodes, dims, cuts``: a tree per cohort, from a sample by hash whose size the depth bounds."""
    want = F.pow(F.lit(2.0), "depth") * SAMPLE_ROWS_PER_LEAF
    share = F.least(F.lit(1.0), F.greatest(want, F.lit(1024)) / F.col("rows"))
    place = F.pmod(F.xxhash64(F.lit(3), "key", "season"), F.lit(1 << 30))
    sample = rows.join(plan.withColumn("share", share).drop("rows"), "cohort").filter(place <= F.col("share") * (1 << 30))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        points = points_of(group["vec"], metric)
        axes = principal_axes(points)
        nodes, dims, cuts = fit_splits(box_coordinates(points, axes)[:, :AXES], int(group["depth"].iloc[0]))
        return pd.DataFrame({"cohort": [group["cohort"].iloc[0]], "axes": [axes.ravel()], "nodes": [nodes], "dims": [dims], "cuts": [cuts]})

    # Order within a sample must not depend on how rows arrived: the fit sums over it.
    def steady(group: pd.DataFrame) -> pd.DataFrame:
        return fit(group.sort_values(["key", "season"]))

    schema = "cohort string, axes array<double>, nodes array<bigint>, dims array<bigint>, cuts array<double>"
    return sample.select("cohort", "key", "season", "vec", "depth").groupBy("cohort").applyInPandas(steady, schema)


def build_index(
    candidates: DataFrame, dims: int, metric: str = "euclidean", keep_per_vector: int | None = None,
    chunk_rows: int = CHUNK_ROWS, force_tree: bool = False, part_rows: int = PART_ROWS,
) -> Index:
    """Lay out ``candidates`` (cohort, key, season, vec), which is read several times: store it first.

    With ``keep_per_vector`` only the first keys of rows with the same vector stay: ties go by key,
    so no other row of such a group can be among the nearest. Where every cohort fits a part, tasks split it themselves and no tree
    is stored, unless ``chunk_rows`` asks for smaller leaves or ``force_tree`` for one in any case.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    rows = candidates.select(F.col("cohort").cast("string").alias("cohort"), "key", "season", "vec")
    spark, kept_path = rows.sparkSession, []
    if keep_per_vector is not None:
        same = Window.partitionBy("cohort", "vec").orderBy("key")
        rows = rows.withColumn("place", F.dense_rank().over(same)).filter(F.col("place") <= keep_per_vector).drop("place")
        kept_path.append(new_path(spark, "candidates"))
        rows = materialize(rows, "candidates", kept_path[0])
    plan = rows.groupBy("cohort").agg(F.count(F.lit(1)).alias("rows"))
    depth = F.least(F.lit(MAX_DEPTH), F.ceil(F.log2(F.ceil(F.col("rows") / chunk_rows).cast("double"))).cast("int"))
    plan = materialize(plan.withColumn("depth", depth), "cohorts")
    widest = plan.agg(F.max("rows")).first()[0] or 0
    if not force_tree and widest <= (part_rows if chunk_rows >= CHUNK_ROWS else min(chunk_rows, part_rows)):
        placed = rows.withColumns({"cell": F.lit(0).cast("long"), "part": F.lit(1).cast("long"), "chunk": F.lit(0)})
        return Index(placed, plan, plan, True, None, metric, dims)
    fitted = materialize(_fitted(rows, plan, metric), "trees")
    left, right = _one_per_slice(rows, plan, _PLACED_ROWS, ["key", "season"], fitted)
    width = min(dims + (metric == "cosine"), AXES + 1)

    def place(group: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        axes = np.asarray(tree["axes"].iloc[0])
        size = int(round(len(axes) ** 0.5))
        spots = box_coordinates(points_of(group["vec"], metric), axes.reshape(size, size))
        splits = Splits(tree["nodes"].iloc[0], tree["dims"].iloc[0], tree["cuts"].iloc[0])
        out = group[["cohort", "key", "season", "vec"]].copy()
        out["cell"], out["spot"] = splits.leaf(spots), list(spots)
        return out

    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.LongType()), T.StructField("spot", T.ArrayType(T.DoubleType()))])
    placed = left.groupBy("cohort", "slice").cogroup(right.groupBy("cohort", "slice")).applyInPandas(place, schema)
    placed = materialize(placed, "placed")
    corners = [f(F.col("spot")[i]) for f in (F.min, F.max) for i in range(width)]
    cells = placed.groupBy("cohort", "cell").agg(
        F.count(F.lit(1)).alias("rows"), F.array(*corners[:width]).alias("low"), F.array(*corners[width:]).alias("high")
    )
    # A part is the subtree at the depth that leaves part_rows to it, or a leaf above that.
    wanted = F.ceil(F.log2(F.greatest(F.ceil(F.col("cohort_rows") / part_rows), F.lit(1)).cast("double"))).cast("int")
    below = F.greatest(F.length(F.bin("cell")) - 1 - wanted, F.lit(0))
    part = F.floor(F.col("cell") / F.pow(F.lit(2.0), below)).cast("long")
    sizes = plan.select("cohort", F.col("rows").alias("cohort_rows"))
    cells = materialize(cells.join(sizes, "cohort").withColumn("part", part).drop("cohort_rows"), "cells")
    edges = [f(F.col(c)[i]) for c, f in (("low", F.min), ("high", F.max)) for i in range(width)]
    parts = cells.groupBy("cohort", F.col("part").alias("cell")).agg(
        F.sum("rows").alias("rows"), F.array(*edges[:width]).alias("low"), F.array(*edges[width:]).alias("high")
    )
    parts = materialize(parts.withColumn("chunks", F.ceil(F.col("rows") / part_rows).cast("int")), "parts")
    remove(spark, kept_path)  # their rows are placed
    chunk = F.pmod(F.xxhash64("key", "season"), F.col("chunks")).cast("int")
    rows = placed.drop("spot")
    if widest <= part_rows:
        rows = rows.withColumns({"part": F.lit(1).cast("long"), "chunk": F.lit(0)})
    else:
        known = cells.select("cohort", "cell", "part").join(parts.select("cohort", F.col("cell").alias("part"), "chunks"), ["cohort", "part"])
        rows = rows.join(known, ["cohort", "cell"]).withColumn("chunk", chunk).drop("chunks")
    return Index(rows, cells, parts, widest <= part_rows, fitted.select("cohort", "axes"), metric, dims)


def _descend(targets: DataFrame, index: Index, work, schema: str) -> DataFrame:
    """Run ``work(targets, spots, nodes)`` where targets of a cohort meet its tree, in slices of bounded size."""
    per = targets.groupBy("cohort").agg(F.count(F.lit(1)).alias("rows"))
    # One row per cohort: parts are bounded by the depth.
    leaves = index.parts.groupBy("cohort").agg(F.array_sort(F.collect_list(F.struct("cell", "rows", "low", "high"))).alias("leaves"))
    tree = index.axes.join(leaves, "cohort")
    left, right = _one_per_slice(targets, per, QUERY_ROWS, ["target_id"], tree)
    metric = index.metric

    def run(group: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if group.empty or tree.empty:
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        axes = np.asarray(tree["axes"].iloc[0])
        size = int(round(len(axes) ** 0.5))
        spots = box_coordinates(points_of(group["vec"], metric), axes.reshape(size, size))
        cells = tree["leaves"].iloc[0]
        nodes = Nodes(
            np.array([x["cell"] for x in cells], np.int64), np.array([x["low"] for x in cells]),
            np.array([x["high"] for x in cells]), np.array([x["rows"] for x in cells], np.int64),
        )
        return work(group, spots, nodes)

    return left.groupBy("cohort", "slice").cogroup(right.groupBy("cohort", "slice")).applyInPandas(run, schema)


def _in_blocks(listed: DataFrame | None, queries: DataFrame, index: Index, work, schema: T.StructType) -> DataFrame:
    """Run ``work`` on every (queries of a chunk, chunk) block, both sides bounded in size.

    ``listed`` says which query wants which chunk, by ids alone; ``queries`` has the rest, one row per ``target_id``. Without it
    every query wants the one part of its cohort. A chunk wanted by many queries is copied, one copy per slice of its queries.
    """
    spark = queries.sparkSession
    if listed is None:
        queries = queries.drop("part", "chunk").withColumns({"part": F.lit(1).cast("long"), "chunk": F.lit(0)})
    else:
        listed = materialize(listed.select("target_id", *_CHUNK), "listed")
        queries = listed.join(queries.drop(*_CHUNK), "target_id")
    per = (queries if listed is None else listed).groupBy(*_CHUNK)
    slices = materialize(per.agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias("slices")), "slices")
    blocks = slices.agg(F.sum("slices")).first()[0] or 1
    parallel = spark.sparkContext.defaultParallelism
    partitions = int(min(max(blocks * 3, parallel * 2), 100_000))
    keys = [*_CHUNK, "slice"]
    own_slice = F.pmod(F.xxhash64("target_id"), F.col("slices")).cast("int")
    left = queries.join(slices, _CHUNK).withColumn("slice", own_slice).drop("slices")
    copies = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    # Renamed to themselves: targets and candidates may be columns of one frame.
    candidates = index.rows.select(*[F.col(c).alias(c) for c in index.rows.columns])
    right = candidates.join(slices, _CHUNK).withColumn("slice", copies).drop("slices")
    return (
        left.repartition(partitions, *keys)
        .groupBy(*keys)
        .cogroup(right.repartition(partitions, *keys).groupBy(*keys))
        .applyInPandas(work, schema)
    )


def _found_schema(targets: DataFrame, index: Index, every_score: bool = False) -> T.StructType:
    return T.StructType(
        [
            T.StructField("target_id", targets.schema["target_id"].dataType),
            T.StructField("key", index.rows.schema["key"].dataType),
            T.StructField("season", index.rows.schema["season"].dataType),
            T.StructField("rank", T.IntegerType()),
            T.StructField("score", T.DoubleType()),
            *[T.StructField(m, T.DoubleType()) for m in (METRICS if every_score else ())],
        ]
    )


def _with_chunks(found: DataFrame, index: Index) -> DataFrame:
    """``target_id, cohort, part, chunk``: every chunk of the found parts."""
    chunks = index.parts.select("cohort", "cell", "chunks")
    listed = found.join(chunks, ["cohort", "cell"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return listed.drop("chunks").withColumnRenamed("cell", "part")


def nearest(
    targets: DataFrame, index: Index, k: int, chunk_rows: int = CHUNK_ROWS, visited: list[DataFrame] | None = None,
    every_score: bool = False,
) -> DataFrame:
    """The k nearest rows of each target's cohort, without rows that carry the target's own key.

    ``targets`` has target_id (unique), cohort, key and vec; a column ``k`` gives a target a number of its own, up to the
    one that the index keeps, and a column ``ranks`` (array) asks for these ranks and the last one only. Returns target_id, key,
    season, rank and score (a distance, or the similarity for cosine), with ``every_score`` those of all metrics too. Ties at
    six decimals go by key, season. ``visited`` collects which parts each target searched, round by round.
    """
    schema = _found_schema(targets, index, every_score)
    work = nearest_in_block(index.metric, every_score)
    own_k = F.coalesce("k", F.lit(k)).cast("int") if "k" in targets.columns else F.lit(k)
    ranks = (F.col("ranks") if "ranks" in targets.columns else F.lit(None)).cast("array<int>").alias("ranks")
    queries = targets.select("target_id", F.col("cohort").cast("string").alias("cohort"), "key", "vec", own_k.alias("k"), ranks)
    unbounded = F.lit(None).cast("double").alias("score")
    if index.whole and visited is None:
        queries = queries.join(index.parts.select("cohort").distinct(), "cohort")
        return _in_blocks(None, queries.select("*", unbounded), index, work, schema)
    queries = materialize(queries, "targets")
    chosen = queries.filter("ranks IS NOT NULL").select("target_id", "ranks")
    queries = queries.withColumn("ranks", F.lit(None).cast("array<int>"))  # lists of several parts are merged whole
    metric = index.metric

    def first(group: pd.DataFrame, spots: np.ndarray, nodes: Nodes) -> pd.DataFrame:
        return pd.DataFrame({"target_id": group["target_id"], "cohort": group["cohort"], "cell": nodes.own_leaf(spots)})

    def further(most: int | None):
        def list_leaves(group: pd.DataFrame, spots: np.ndarray, nodes: Nodes) -> pd.DataFrame:
            limit = _squared_limit(group["score"].to_numpy(dtype=float), metric, _SLACK)
            query, leaf = nodes.within(spots, limit, [set(x) for x in group["seen"]], most)
            return pd.DataFrame({"target_id": group["target_id"].to_numpy()[query], "cohort": group["cohort"].to_numpy()[query], "cell": leaf})

        return list_leaves

    kind = targets.schema["target_id"].dataType.simpleString()
    listing = f"target_id {kind}, cohort string, cell long"
    own = queries.select("target_id", F.col("k").alias("own_k"))

    def searched(leaves: DataFrame, best: DataFrame | None) -> DataFrame:
        """The best rows of each target after a search of ``leaves`` too."""
        asked = queries.drop("cohort")
        asked = asked.select("*", unbounded) if best is None else asked.join(bounds(best), "target_id", "left")
        found = _in_blocks(_with_chunks(leaves, index), asked, index, work, schema)
        found = found if best is None else best.drop("own_k").unionByName(found)
        rank = F.row_number().over(_by_score("target_id", metric))
        return found.join(own, "target_id").withColumn("rank", rank).filter(F.col("rank") <= F.col("own_k"))

    def bounds(best: DataFrame) -> DataFrame:
        return best.filter("rank = own_k").select("target_id", "score")

    spark = queries.sparkSession
    leaves = materialize(_descend(queries, index, first, listing), "leaves")
    seen, best, past = leaves, None, []
    for most in _ROUNDS:
        best_path, leaves_path = new_path(spark, "best"), new_path(spark, "leaves")
        # Of a round only its best rows and the next leaves stay, and the best rows of the round before go.
        with scope(spark):
            best = materialize(searched(leaves, best), "best", best_path)
            remove(spark, past)
            been = seen.groupBy("target_id").agg(F.collect_list("cell").alias("seen"))  # as many as the rounds before allow
            asked = queries.join(been, "target_id").join(bounds(best), "target_id", "left")
            leaves = materialize(_descend(asked, index, further(most), listing), "leaves", leaves_path)
        past = [best_path]
        seen = seen.unionByName(leaves)
    if visited is not None:
        visited.append(seen)
    found = searched(leaves, best).drop("own_k")
    if "ranks" not in targets.columns:
        return found
    found = found.withColumn("last", F.max("rank").over(Window.partitionBy("target_id"))).join(chosen, "target_id", "left")
    shown = F.col("ranks").isNull() | (F.col("rank") == F.col("last")) | F.array_contains("ranks", F.col("rank"))
    return found.filter(shown).drop("last", "ranks")


def nearest_by_metric(targets: DataFrame, indexes: dict[str, Index], k: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The k nearest under each metric: ``target_id, metric, key, season, rank`` and the scores of all metrics.

    Metrics that share their rows, and search them in one block, send rows and targets over the network once.
    """
    ranked = None
    for metrics in _sharing(indexes):
        index = indexes[metrics[0]]
        if len(metrics) == 1:
            found = nearest(targets, index, k, chunk_rows, every_score=True).withColumn("metric", F.lit(metrics[0]))
        else:
            kept = [f for f in _found_schema(targets, index, True).fields if f.name != "score"]
            schema = T.StructType([*kept, T.StructField("metric", T.StringType())])
            unbounded = [F.lit(None).cast(kind).alias(c) for c, kind in (("ranks", "array<int>"), ("score", "double"))]
            queries = targets.select("target_id", F.col("cohort").cast("string").alias("cohort"), "key", "vec", F.lit(k).alias("k"), *unbounded)
            queries = queries.join(index.parts.select("cohort").distinct(), "cohort")
            found = _in_blocks(None, queries, index, _under_each(metrics, schema.names), schema)
        found = found.select("target_id", "metric", "key", "season", "rank", *METRICS)
        ranked = found if ranked is None else ranked.unionByName(found)
    return ranked


def _sharing(indexes: dict[str, Index]) -> list[list[str]]:
    """Metrics by the rows they search: those that share theirs can be searched in one pass."""
    groups: list[list[str]] = []
    for metric, index in indexes.items():
        same = next((g for g in groups if index.whole and indexes[g[0]].rows is index.rows), None)
        groups.append([metric]) if same is None else same.append(metric)
    return groups


def _under_each(metrics: list[str], columns: list[str]):
    searches = {m: nearest_in_block(m, True) for m in metrics}

    def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([work(queries, candidates).assign(metric=m) for m, work in searches.items()])[columns]

    return search


def _by_score(target: str, metric: str):
    score = F.round("score", DECIMALS)
    return Window.partitionBy(target).orderBy(score.desc() if metric == "cosine" else score.asc(), "key", "season")


def rank_of(pairs: DataFrame, index: Index, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rank of one named candidate per target: one more than the rows that come before it.

    ``pairs`` has target_id, cohort, key, vec, other_key, other_season and score; the target's own
    rows do not count. ``pairs`` is read several times, so it should be a stored table.
    """
    total = _rows_before(pairs, index)
    return pairs.join(total, "target_id", "left").select("target_id", (F.coalesce("nearer", F.lit(0)) + 1).alias("rank"))


def ranks_by_metric(pairs: DataFrame, indexes: dict[str, Index], chunk_rows: int = CHUNK_ROWS) -> list[DataFrame]:
    """Ranks of one named candidate per target as columns ``<metric>_rank``, in as few frames as there are searches.

    ``pairs`` is that of ``rank_of`` with a score per metric, in columns of its name. Metrics that share their rows, and count
    them in one block, send rows and pairs over the network once.
    """
    found = []
    for metrics in _sharing(indexes):
        index = indexes[metrics[0]]
        if len(metrics) == 1:
            ranks = rank_of(pairs.withColumn("score", F.col(metrics[0])), index, chunk_rows)
            found.append(ranks.withColumnRenamed("rank", f"{metrics[0]}_rank"))
            continue
        kind = pairs.schema["target_id"].dataType
        schema = T.StructType([T.StructField("target_id", kind), *[T.StructField(f"{m}_rank", T.LongType()) for m in metrics]])
        asked = pairs.select("target_id", F.col("cohort").cast("string").alias("cohort"), "key", "vec", "other_key", "other_season", *metrics)
        found.append(_in_blocks(None, asked, index, _counts_under(metrics), schema))
    return found


def _counts_under(metrics: list[str]):
    works = {m: nearer_in_block(m) for m in metrics}

    def count(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or candidates.empty:
            return pd.DataFrame({c: [] for c in ("target_id", *[f"{m}_rank" for m in metrics])})
        ranks = {f"{m}_rank": work(queries.assign(score=queries[m]), candidates)["nearer"].to_numpy() + 1 for m, work in works.items()}
        return pd.DataFrame({"target_id": queries["target_id"].to_numpy(), **ranks})

    return count


def _rows_before(asked: DataFrame, index: Index) -> DataFrame:
    """Rows before the named candidate, own rows left out; each block returns one count per question.

    A part whose box lies beyond the named candidate counts nothing; within a part, leaves that are wholly nearer
    count their size and only those between are searched.
    """
    kind = asked.schema["target_id"].dataType
    schema = T.StructType([T.StructField("target_id", kind), T.StructField("nearer", T.LongType())])
    work = nearer_in_block(index.metric)
    asked = asked.select("target_id", F.col("cohort").cast("string").alias("cohort"), "key", "vec", "other_key", "other_season", "score")
    if index.whole:  # one block holds all rows of a question's cohort
        return _in_blocks(None, asked, index, work, schema)
    metric = index.metric

    def reach(group: pd.DataFrame, spots: np.ndarray, nodes: Nodes) -> pd.DataFrame:
        limit = _squared_limit(group["score"].to_numpy(dtype=float), metric, _SLACK)
        query, part = nodes.within(spots, limit, [()] * len(group), None)
        return pd.DataFrame({"target_id": group["target_id"].to_numpy()[query], "cohort": group["cohort"].to_numpy()[query], "cell": part})

    shape = f"target_id {kind.simpleString()}, cohort string, cell long"
    listed = _with_chunks(_descend(asked, index, reach, shape), index)
    counts = _in_blocks(listed, asked, index, work, schema)
    return counts.groupBy("target_id").agg(F.sum("nearer").alias("nearer"))
