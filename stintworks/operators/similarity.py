"""Similar entities, metric comparison, explanations and role rankings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from stintworks.functions.blocks import DECIMALS, METRICS
from stintworks.functions.cleaning import folded, trimmed
from stintworks.operators.cohorts import (
    COHORT, cohort_id, missing_total, moments, role_mask, similarity_population, zscores,
)
from stintworks.operators.constraints import unique_violations
from stintworks.operators.neighbours import (
    CHUNK_ROWS, Index, build_index, nearest, nearest_by_metric, pair_scores, ranks_by_metric,
)
from stintworks.operators.resolve import (
    COHORT_TOO_SMALL, MAX_SIMILAR, MISSING_FEATURES, OK, flag_not_eligible, resolve, with_detail,
)
from stintworks.schemas import FEATURE_LABELS, FEATURES
from stintworks.workspace import materialize, shuffles_end

MIN_COHORT = 3
# Targets that want more rows are searched apart.
WIDE = 256
TOP_FEATURES = 5
SHOWN = ["player_name", "primary_squad_name", "primary_competition_name", "position_raw",
         "position_group", "minutes", "stint_count"]


@dataclass
class Space:
    """Standardised population: one row per entity and season with its cohort and z vector."""

    rows: DataFrame
    moments: DataFrame
    cohort_cols: Sequence[str]
    features: Sequence[str]


def build_space(
    canonical: DataFrame, cohort_cols: Sequence[str] = COHORT, features: Sequence[str] = FEATURES
) -> Space:
    """Moments first, stored and small, then one pass that standardises and stores the rows.

    Cohorts with missing feature values are left out; ``cohort_outcomes`` and the outcomes of requests say
    so. An entity and season must occur once: a second row would be its own neighbour.
    """
    population = similarity_population(canonical)
    wide = materialize(moments(population, cohort_cols, features), "moments")
    complete = wide.filter(missing_total(features) == 0)
    scored = zscores(population, complete, cohort_cols, features).select(
        cohort_id(cohort_cols).alias("cohort"),
        F.col("canonical_player_key").alias("key"),
        "season", *SHOWN, "cohort_size", "z",
    )
    rows = materialize(scored, "space")
    with shuffles_end(rows.sparkSession):
        twice = unique_violations(rows, ["key", "season"]).select("key", "season").take(3)
    if twice:
        raise ValueError("entities with several rows in one season: " + ", ".join(f"{r.key} {r.season}" for r in twice))
    return Space(rows, wide, cohort_cols, features)


def target_id(key: str = "key", season: str = "season") -> Column:
    return F.concat_ws("|", key, F.col(season).cast("string"))


def all_targets(space: Space, min_cohort: int = MIN_COHORT) -> DataFrame:
    rows = space.rows.filter(F.col("cohort_size") >= min_cohort)
    return rows.select(
        target_id().alias("target_id"), "cohort", "key", "season", F.col("z").alias("vec")
    )


def index_of(
    space: Space, metric: str, k: int | None, vec: Column | None = None, chunk_rows: int = CHUNK_ROWS, force_tree: bool = False
) -> Index:
    """Search index over the space; ``k`` None keeps every row, as counting ranks needs."""
    rows = space.rows.select("cohort", "key", "season", (F.col("z") if vec is None else vec).alias("vec"))
    return build_index(rows, len(space.features), metric, None if k is None else k + 1, chunk_rows, force_tree)


def neighbours(
    space: Space, targets: DataFrame | None = None, metric: str = "euclidean", k: int = 10,
    min_cohort: int = MIN_COHORT, chunk_rows: int = CHUNK_ROWS, force_tree: bool = False,
) -> DataFrame:
    """k nearest per target; ``targets`` None means every entity of the space.

    A column ``k`` of ``targets`` gives a target a number of its own. The few that want more than ``WIDE`` rows are
    searched apart, over an index that keeps all rows, so the others are none the slower for them.
    """
    if k < 1:
        raise ValueError("k must be 1 or greater")
    targets = all_targets(space, min_cohort) if targets is None else targets
    if "k" not in targets.columns:
        return nearest(targets, index_of(space, metric, k, chunk_rows=chunk_rows, force_tree=force_tree), k, chunk_rows)
    targets = materialize(targets, "targets")
    least, widest = targets.agg(F.min("k"), F.max(F.when(F.col("k") <= WIDE, F.col("k")))).first()
    if least is not None and least < 1:
        raise ValueError("k must be 1 or greater")
    near = index_of(space, metric, widest or 1, chunk_rows=chunk_rows, force_tree=force_tree)
    found = nearest(targets.filter(F.col("k") <= WIDE), near, widest or 1, chunk_rows)
    far = targets.filter(F.col("k") > WIDE)
    if far.isEmpty():
        return found
    everything = index_of(space, metric, None, chunk_rows=chunk_rows, force_tree=force_tree)
    return found.unionByName(nearest(far, everything, 1, chunk_rows))


def others_of(targets: DataFrame, space: Space) -> DataFrame:
    """``target_id, others``: how many rows of the target's cohort carry another key, so what ranks there are."""
    targets = targets.select("target_id", "cohort", "key")
    sizes = space.rows.groupBy("cohort").agg(F.count(F.lit(1)).alias("rows"))
    own = space.rows.join(targets.select("cohort", "key").distinct(), ["cohort", "key"], "left_semi")
    own = own.groupBy("cohort", "key").agg(F.count(F.lit(1)).alias("own_rows"))
    counted = targets.join(sizes, "cohort").join(own, ["cohort", "key"], "left")
    return counted.select("target_id", (F.col("rows") - F.coalesce("own_rows", F.lit(0))).alias("others"))


def searched_share(space: Space, k: int = 10, chunk_rows: int = CHUNK_ROWS) -> float:
    """Which part of all (target, row of its cohort) combinations is in the blocks that a search of every entity forms.

    Leaves that a task leaves out within a block are not told.
    """
    index, targets, visited = index_of(space, "euclidean", k, chunk_rows=chunk_rows), all_targets(space), []
    if index.whole:
        return 1.0
    nearest(targets, index, k, chunk_rows, visited)
    looked = visited[0].join(index.parts.select("cohort", "cell", "rows"), ["cohort", "cell"]).agg(F.sum("rows")).first()[0]
    sizes = index.cells.groupBy("cohort").agg(F.sum("rows").alias("rows"))
    return round((looked or 0) / (targets.join(sizes, "cohort").agg(F.sum("rows")).first()[0] or 1), 4)


def _cohort_trouble(space: Space) -> tuple[Column, Column]:
    """Status and text of a row of cohort moments; the text names the features that lack values."""
    gaps = [F.when(F.col(f"missing_{f}") > 0, F.concat(F.lit(f"{f}: "), F.col(f"missing_{f}"))) for f in space.features]
    missing = F.concat(F.lit("Missing feature values detected: "), F.concat_ws(", ", *gaps))
    status = F.when(F.col("cohort_size") < MIN_COHORT, COHORT_TOO_SMALL).when(missing_total(space.features) > 0, MISSING_FEATURES).otherwise(OK)
    return status, missing


def cohort_outcomes(space: Space) -> DataFrame:
    """Every cohort of the population with its size and whether its entities can be searched.

    Joined with the population on the cohort columns it tells for each entity why ``neighbours``,
    ``compare_metrics`` or ``candidate_ranks`` have no rows for it.
    """
    status, missing = _cohort_trouble(space)
    small = F.format_string("Not enough eligible players in cohort %s.", F.concat_ws("|", *space.cohort_cols))
    rows = space.moments.select(*space.cohort_cols, "cohort_size", status.alias("status"), missing.alias("missing"))
    return rows.select(
        *space.cohort_cols, "cohort_size", "status",
        F.when(F.col("status") == COHORT_TOO_SMALL, small).when(F.col("status") == MISSING_FEATURES, F.col("missing")).alias("detail"),
    )


def with_cohort_status(resolved: DataFrame, space: Space) -> DataFrame:
    """Outcomes whose cohort is too small, or lacks feature values, say so; the text names the features."""
    trouble, missing = _cohort_trouble(space)
    cohorts = space.moments.select(
        *[F.col(c).alias(f"matched_{c}") for c in space.cohort_cols], trouble.alias("trouble"), missing.alias("missing")
    )
    outcomes = resolved.join(cohorts, [f"matched_{c}" for c in space.cohort_cols], "left")
    status = F.when(F.col("status") == OK, F.coalesce("trouble", F.lit(OK))).otherwise(F.col("status"))
    kept = F.when(F.col("status") == F.col("old_status"), F.col("old_detail")).otherwise(F.col("detail"))
    told = F.when(F.col("status") == MISSING_FEATURES, F.col("missing")).otherwise(kept)
    outcomes = outcomes.withColumns({"old_status": F.col("status"), "old_detail": F.col("detail")})
    return with_detail(outcomes.withColumn("status", status)).withColumn("detail", told).select(*resolved.columns)


def similar(
    requests: DataFrame,
    canonical: DataFrame,
    metric: str = "euclidean",
    k: int = 10,
    features: Sequence[str] = FEATURES,
    cohort_cols: Sequence[str] = COHORT,
    eligible_only: bool = False,
    space: Space | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(outcomes, neighbours)`` for a batch of requests.

    Every request has an outcome. Requests for the same entity share one search, up to the widest
    limit asked for that entity; ``k`` serves requests that give none. ``eligible_only`` resolves
    names within the similarity population, where ineligible entities are simply not found.
    """
    space = space or build_space(canonical, cohort_cols, features)
    searched = similarity_population(canonical) if eligible_only else canonical
    if not 1 <= k <= MAX_SIMILAR:
        raise ValueError(f"k must be between 1 and {MAX_SIMILAR}")
    outcomes = with_cohort_status(flag_not_eligible(resolve(requests, searched)), space)
    outcomes = materialize(outcomes, "outcomes")

    limit = F.coalesce("k", F.lit(k)) if "k" in requests.columns else F.lit(k)
    served = outcomes.filter(F.col("status") == OK).select(
        "request_id", target_id("matched_canonical_player_key", "matched_season").alias("target_id"),
        limit.alias("wanted"),
    )
    targets = all_targets(space).join(served.groupBy("target_id").agg(F.max("wanted").alias("k")), "target_id")
    found = neighbours(space, targets, metric, k)
    return outcomes, served.join(found, "target_id").filter(F.col("rank") <= F.col("wanted")).drop("wanted")


def with_vectors(pairs: DataFrame, space: Space) -> DataFrame:
    """Add ``target_z`` and ``candidate_z`` to rows of (target_id, key, season)."""
    known = space.rows.select(target_id().alias("target_id"), "cohort", F.col("key").alias("target_key"),
                              F.col("season").alias("target_season"), F.col("z").alias("target_z"))
    others = space.rows.select("key", "season", F.col("z").alias("candidate_z"))
    return pairs.join(known, "target_id").join(others, ["key", "season"])


def _indexes(space: Space, k: int | None, chunk_rows: int, force_tree: bool = False) -> dict[str, Index]:
    """One index per metric; without a tree all share a layout, with one the two distances do."""
    plain = index_of(space, "euclidean", k, chunk_rows=chunk_rows, force_tree=force_tree)
    cosine = plain.under("cosine") if plain.single else index_of(space, "cosine", k, chunk_rows=chunk_rows, force_tree=force_tree)
    return {"euclidean": plain, "manhattan": plain.under("manhattan"), "cosine": cosine}


def compare_metrics(
    space: Space, targets: DataFrame | None = None, k: int = 10, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """The k nearest under each metric, every row with all three scores."""
    targets = all_targets(space, min_cohort=1) if targets is None else targets
    # The block has both vectors, so rows bring their scores along.
    found = nearest_by_metric(targets, _indexes(space, k, chunk_rows), k, chunk_rows)
    return found.select("target_id", "metric", "rank", "key", "season", *METRICS)


def find_candidates(targets: DataFrame, space: Space) -> DataFrame:
    """First row by key and season of each target's cohort that carries the asked name.

    ``targets`` has the columns of ``all_targets`` plus ``candidate_name``. Names without a row get
    NULL keys.
    """
    asked = targets.withColumn("folded", folded(trimmed(F.col("candidate_name"))))
    wanted = materialize(asked.select("cohort", "folded").distinct(), "wanted")
    names = space.rows.select("cohort", "key", "season", folded(F.col("player_name")).alias("folded")).filter("key IS NOT NULL")
    # Only asked names move. Two keys per name are enough: a target may have to skip its own.
    rows = names.join(wanted, ["cohort", "folded"], "left_semi").groupBy("cohort", "folded", "key").agg(F.min(F.struct("season")).alias("first"))
    place = F.row_number().over(Window.partitionBy("cohort", "folded").orderBy("key"))
    rows = rows.withColumn("place", place).filter(F.col("place") <= 2)
    entry = F.struct(F.col("key").alias("other_key"), F.col("first.season").alias("other_season"))
    lists = rows.groupBy("cohort", "folded").agg(F.array_sort(F.collect_list(entry)).alias("others"))
    other = F.get(F.filter("others", lambda o: o["other_key"] != F.col("key")), F.lit(0))
    found = asked.join(materialize(lists, "candidates"), ["cohort", "folded"], "left").withColumn("other", other)
    return found.select(*targets.columns, F.col("other.other_key").alias("other_key"), F.col("other.other_season").alias("other_season"))


def candidate_ranks(
    named: DataFrame, space: Space, chunk_rows: int = CHUNK_ROWS, question: str = "target_id", force_tree: bool = False
) -> DataFrame:
    """Scores and ranks of one named candidate per target under all three metrics.

    ``named`` comes from ``find_candidates`` (or any frame with target_id, other_key, other_season);
    the status says where the cohort has no such candidate. With several candidates per target,
    ``question`` names a column that is unique.
    """
    ids = list(dict.fromkeys(["target_id", question]))
    named = materialize(named.select(*ids, "other_key", "other_season"), "asked")
    present = named.filter(F.col("other_key").isNotNull())
    pairs = present.select(*ids, F.col("other_key").alias("key"), F.col("other_season").alias("season"))
    scores = pair_scores(F.col("target_z"), F.col("candidate_z"), len(space.features))
    scored = with_vectors(pairs, space).select(
        F.col(question).alias("target_id"), "cohort", F.col("target_key").alias("key"), F.col("target_z").alias("vec"),
        F.col("key").alias("other_key"), F.col("season").alias("other_season"),
        *[c.alias(m) for m, c in scores.items()],
    )
    scored = materialize(scored, "named")
    result = named.join(scored.select(F.col("target_id").alias(question), *METRICS), question, "left")
    for ranks in ranks_by_metric(scored, _indexes(space, None, chunk_rows, force_tree), chunk_rows):
        result = result.join(ranks.withColumnRenamed("target_id", question), question, "left")
    result = result.select(*ids, "other_key", "other_season", *METRICS, *[f"{m}_rank" for m in METRICS])
    status = F.when(F.col("other_key").isNull(), "CANDIDATE_NOT_FOUND").otherwise(OK)
    return result.withColumn("status", status)


def _unpivoted(pairs: DataFrame, features: Sequence[str]) -> DataFrame:
    entries = [
        F.struct(
            F.lit(i).alias("place"), F.lit(f).alias("feature"), F.lit(FEATURE_LABELS.get(f, f)).alias("label"),
            F.col("target_z")[i].alias("tz"), F.col("candidate_z")[i].alias("cz"),
        )
        for i, f in enumerate(features)
    ]
    kept = [c for c in pairs.columns if c not in ("target_z", "candidate_z")]
    return pairs.select(*kept, F.explode(F.array(*entries)).alias("e")).select(*kept, "e.*")


def explain_euclidean(pairs: DataFrame, space: Space) -> DataFrame:
    """Per feature: gap, squared contribution and its share of the squared distance."""
    return euclidean_features(euclidean_pairs(pairs, space), space).select(
        "target_id", "key", "season", "rank", "feature", "label", "target_z", "candidate_z",
        "absolute_gap", "squared_contribution", "distance_share_pct", "distance",
    )


def euclidean_pairs(pairs: DataFrame, space: Space) -> DataFrame:
    """One row per pair with both vectors and their ``squared`` distance."""
    gaps = [F.col("target_z")[i] - F.col("candidate_z")[i] for i in range(len(space.features))]
    return with_vectors(pairs, space).withColumn("squared", sum([g * g for g in gaps[1:]], gaps[0] * gaps[0]))


def euclidean_features(wide: DataFrame, space: Space) -> DataFrame:
    """The rows of ``euclidean_pairs`` feature by feature; other columns of theirs stay."""
    rows = _unpivoted(wide, space.features)
    gap = F.col("tz") - F.col("cz")
    share = F.when(F.col("squared") > 0, gap * gap / F.col("squared") * 100).otherwise(F.lit(0.0))
    return rows.withColumns({
        "target_z": F.col("tz"), "candidate_z": F.col("cz"), "absolute_gap": F.abs(gap),
        "squared_contribution": gap * gap, "distance_share_pct": share, "distance": F.sqrt("squared"),
    })


def explain_cosine(pairs: DataFrame, space: Space) -> DataFrame:
    """Per feature: gap, contribution to the cosine and the sides of the average; ``similarity`` is their total.

    A pair with a zero-length vector cannot be explained: status ``ZERO_VECTOR``, no contribution.
    """
    return cosine_features(cosine_pairs(pairs, space), space).select(
        "target_id", "key", "season", "rank", "feature", "label", "target_z", "candidate_z",
        "z_gap", "cosine_contribution", "direction", "similarity", "status",
    )


def cosine_pairs(pairs: DataFrame, space: Space) -> DataFrame:
    """One row per pair with both vectors, the product of their lengths, ``dot`` and ``status``."""
    dims = len(space.features)
    norm = [
        F.sqrt(sum([F.col(c)[i] * F.col(c)[i] for i in range(1, dims)], F.col(c)[0] * F.col(c)[0]))
        for c in ("target_z", "candidate_z")
    ]
    dot = sum([F.col("target_z")[i] * F.col("candidate_z")[i] for i in range(1, dims)], F.col("target_z")[0] * F.col("candidate_z")[0])
    wide = with_vectors(pairs, space).withColumn("norms", norm[0] * norm[1]).withColumn("dot", dot)
    return wide.withColumn("status", F.when(F.col("norms") > 0, OK).otherwise("ZERO_VECTOR"))


def cosine_features(wide: DataFrame, space: Space) -> DataFrame:
    """The rows of ``cosine_pairs`` feature by feature; other columns of theirs stay."""
    rows = _unpivoted(wide, space.features)
    tz, cz = F.col("tz"), F.col("cz")
    # The three directions.
    direction = (
        F.when((tz > 0) & (cz > 0), "both above cohort avg")
        .when((tz < 0) & (cz < 0), "both below cohort avg")
        .otherwise("opposite sides of avg")
    )
    return rows.withColumns({
        "target_z": tz, "candidate_z": cz, "z_gap": F.abs(tz - cz),
        "cosine_contribution": F.when(F.col("norms") > 0, tz * cz / F.col("norms")),
        "direction": direction,
        "similarity": F.when(F.col("norms") > 0, F.col("dot") / F.col("norms")),
    })


def nth_neighbour(
    space: Space, rank: int = 1, metric: str = "euclidean", targets: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(pairs, outcomes)``: the neighbour at ``rank`` per target, and who has that many."""
    if rank < 1:
        raise ValueError("rank must be 1 or greater")
    targets = all_targets(space) if targets is None else targets
    # The last rank says how many there are, so no list is stored.
    asked = targets.withColumns({"k": F.lit(rank), "ranks": F.array(F.lit(rank))})
    found = materialize(neighbours(space, asked, metric), "found")
    available = found.groupBy("target_id").agg(F.max("rank").cast("long").alias("available"))
    outcomes = targets.select("target_id").join(available, "target_id", "left").select(
        "target_id", F.coalesce("available", F.lit(0)).alias("available"),
        F.when(F.col("available") >= rank, OK).otherwise("RANK_UNAVAILABLE").alias("status"),
    )
    return found.filter(F.col("rank") == rank), outcomes


def top_features(
    explanation: DataFrame, by: str, ascending: bool = False, n: int = TOP_FEATURES,
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """The first ``n`` features of every pair by ``by``; ties keep feature order."""
    place = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    value = F.round(by, DECIMALS)
    order = [value.asc() if ascending else value.desc(), place.asc()]
    pair = Window.partitionBy("target_id", "key", "season").orderBy(*order)
    return explanation.withColumn("position", F.row_number().over(pair)).filter(F.col("position") <= n)


def role_neighbours(
    space: Space, targets: DataFrame | None = None, k: int = 10, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Nearest by the features of the position group's role set only.

    Features outside the set are zero on both sides, so every cohort keeps the same vector length.
    """
    mask = role_mask(F.col("position_group"), space.features)
    masked = F.array(*[F.when(mask[i] == 1, F.col("z")[i]).otherwise(F.lit(0.0)) for i in range(len(space.features))])
    with_role = space.rows.filter(mask.isNotNull()).withColumn("z", masked)
    narrowed = Space(with_role, space.moments, space.cohort_cols, space.features)
    own = all_targets(narrowed, min_cohort=1)
    if targets is not None:
        own = own.join(targets.select("target_id"), "target_id", "left_semi")
    return nearest(own, index_of(narrowed, "euclidean", k, chunk_rows=chunk_rows), k, chunk_rows)


def role_experiment(
    space: Space, targets: DataFrame | None = None, n: int = 10, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """How many of the top ``n`` the plain and the role ranking share, per target."""
    chosen = all_targets(space, min_cohort=1) if targets is None else targets
    plain = nearest(chosen, index_of(space, "euclidean", n, chunk_rows=chunk_rows), n, chunk_rows)
    by_role = role_neighbours(space, targets, n, chunk_rows)
    lists = plain.select("target_id", "key", "season", F.lit(1).alias("plain"), F.lit(0).alias("role")).unionByName(
        by_role.select("target_id", "key", "season", F.lit(0).alias("plain"), F.lit(1).alias("role"))
    )
    both = lists.groupBy("target_id", "key", "season").agg(F.sum("plain").alias("plain"), F.sum("role").alias("role"))
    overlap = both.groupBy("target_id").agg(
        F.sum(F.when((F.col("plain") > 0) & (F.col("role") > 0), 1).otherwise(0)).alias("overlap")
    )
    groups = space.rows.select(target_id().alias("target_id"), role_mask(F.col("position_group"), space.features).isNotNull().alias("has_role"))
    return (
        chosen.select("target_id")
        .join(groups, "target_id")
        .join(overlap, "target_id", "left")
        .select(
            "target_id",
            F.when(F.col("has_role"), F.coalesce("overlap", F.lit(0))).alias("overlap"),
            F.when(F.col("has_role"), OK).otherwise("NO_ROLE_FEATURES").alias("status"),
        )
    )
