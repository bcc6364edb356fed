"""Fold club stints into one row per entity and season."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stintworks.functions.rates import canonical_eligible, per90, position_group, sample_quality
from stintworks.schemas import FEATURES, SUMMED

# Stints with equal minutes keep load order.
LOAD_ORDER = ("imported_at", "batch_id", "source_row_number")
PRIMARY = {
    "nation_raw": "nation_raw",
    "nation_country_code": "nation_country_code",
    "nation_fifa_code": "nation_fifa_code",
    "position_raw": "position_raw",
    "primary_squad_name": "squad_name",
    "primary_competition_name": "competition_name",
}


def _bar_joined(names: Column) -> Column:
    return F.array_join(F.array_sort(names), " | ")


def joined_names(column: str) -> Column:
    """Distinct names in order, joined by a bar."""
    return _bar_joined(F.collect_set(column))


def _longest_first(tie_break: Sequence[str]) -> Column:
    return F.struct(-F.coalesce(F.col("minutes"), F.lit(-1)), *tie_break)


def _attributes(name: str) -> Column:
    return F.struct(*[F.col(src).alias(out) for out, src in {"player_name": name, **PRIMARY}.items()])


def fold_stints(
    stints: DataFrame,
    key: str,
    name: str = "player_name",
    tie_break: Sequence[str] = LOAD_ORDER,
) -> DataFrame:
    """One row per (key, season): sums, counts, name lists and the longest stint's attributes.

    A single aggregation does the work of window, roll-up and self join, so the stints shuffle
    once and every task sends one partial row per key, also for a key that holds most rows.
    """
    totals = stints.groupBy(key, "season").agg(
        *([F.max("source_player_key").alias("source_player_key")] if key != "source_player_key" else []),
        F.max("season_label").alias("season_label"),
        F.max("age").alias("age"),
        F.max("born_year").alias("born_year"),
        F.count(F.lit(1)).alias("stint_count"),
        joined_names("squad_name").alias("squad_names"),
        joined_names("competition_name").alias("competition_names"),
        *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in SUMMED],
        F.min_by(_attributes(name), _longest_first(tie_break)).alias("primary_stint"),
    )
    return totals.select(*[c for c in totals.columns if c != "primary_stint"], "primary_stint.*")


# Columns of a partial fold, and how two partial folds of a key combine.
_GREATEST = ("season_label", "age", "born_year")
_NAMES = {"squads": "squad_name", "competitions": "competition_name"}


def partial_fold(
    stints: DataFrame, key: str, name: str = "player_name", tie_break: Sequence[str] = LOAD_ORDER
) -> DataFrame:
    """One row per (key, season) that further stints can be merged into: sums, name arrays, the longest stint and its order."""
    greatest = [*_GREATEST] if key == "source_player_key" else ["source_player_key", *_GREATEST]
    return stints.groupBy(key, "season").agg(
        *[F.max(c).alias(c) for c in greatest],
        F.count(F.lit(1)).alias("stint_count"),
        *[F.collect_set(c).alias(out) for out, c in _NAMES.items()],
        *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in SUMMED],
        F.min_by(_attributes(name), _longest_first(tie_break)).alias("primary_stint"),
        F.min(_longest_first(tie_break)).alias("longest"),
    )


def merge_folds(partials: DataFrame, key: str) -> DataFrame:
    """Partial folds of the same (key, season) as one, again a partial fold; the order of merges does not matter."""
    greatest = [c for c in ("source_player_key", *_GREATEST) if c != key]
    return partials.groupBy(key, "season").agg(
        *[F.max(c).alias(c) for c in greatest],
        F.sum("stint_count").alias("stint_count"),
        *[F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in _NAMES],
        *[F.sum(c).alias(c) for c in SUMMED],
        F.min_by("primary_stint", "longest").alias("primary_stint"),
        F.min("longest").alias("longest"),
    )


def finished_fold(partials: DataFrame, key: str) -> DataFrame:
    """Canonical rows of merged partial folds, one per row."""
    rest = [c for c in partials.columns if c not in (*_NAMES, "primary_stint", "longest")]
    names = [_bar_joined(F.col("squads")).alias("squad_names"), _bar_joined(F.col("competitions")).alias("competition_names")]
    return described(partials.select(*rest, *names, "primary_stint.*"), key)


def canonical(
    stints: DataFrame,
    key: str = "canonical_player_key",
    name: str = "canonical_player_name",
    tie_break: Sequence[str] = LOAD_ORDER,
) -> DataFrame:
    """Canonical layer: folded stints with group, eligibility, quality band and feature rates."""
    return described(fold_stints(stints, key, name, tie_break), key)


def described(folded: DataFrame, key: str) -> DataFrame:
    """Folded rows with what follows from them."""
    keys = [key] if key == "source_player_key" else [key, "source_player_key"]
    return folded.select(
        *keys, "season", "season_label", "player_name",
        "nation_raw", "nation_country_code", "nation_fifa_code", "position_raw",
        position_group(F.col("position_raw")).alias("position_group"),
        "primary_squad_name", "primary_competition_name", "squad_names", "competition_names",
        "stint_count", "age", "born_year", *SUMMED,
        canonical_eligible(F.col("minutes"), F.col("position_raw")).alias("is_similarity_eligible"),
        sample_quality(F.col("minutes")).alias("sample_quality"),
        *[per90(f.removesuffix("_per90")).alias(f) for f in FEATURES],
    )


def canonical_by_source_key(stints: DataFrame, tie_break: Sequence[str] = LOAD_ORDER) -> DataFrame:
    """The layer before identity resolution."""
    return canonical(stints, "source_player_key", "player_name", tie_break)


def latest_batch_per_season(stints: DataFrame) -> DataFrame:
    """Keep only the newest batch of each season, for callers who do not want seasons doubled."""
    newest = stints.groupBy("season").agg(
        F.max(F.struct("imported_at", "batch_id")).getField("batch_id").alias("batch_id")
    )
    return stints.join(newest, ["season", "batch_id"], "left_semi")
