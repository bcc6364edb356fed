"""Nested result records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stintworks.functions.blocks import DECIMALS
from stintworks.operators.resolve import OK
from stintworks.operators.similarity import Space, target_id
from stintworks.schemas import FEATURES

# Sections of a profile, output name -> canonical column.
PROFILE = {
    "identity": {
        "canonical_player_key": "canonical_player_key", "source_player_key": "source_player_key",
        "name": "player_name", "nation": "nation_raw", "nation_country_code": "nation_country_code",
        "nation_fifa_code": "nation_fifa_code", "age": "age", "born_year": "born_year",
    },
    "season": {
        "season": "season", "label": "season_label", "primary_club": "primary_squad_name",
        "primary_competition": "primary_competition_name", "clubs": "squad_names",
        "competitions": "competition_names", "stint_count": "stint_count",
    },
    "role": {"position": "position_raw", "position_group": "position_group"},
    "usage": {c: c for c in ["appearances", "starts", "minutes"]},
    "production": {
        c: c
        for c in ["goals", "assists", "goal_contributions", "non_penalty_goals", "penalties_scored",
                  "penalties_attempted", "shots", "shots_on_target"]
    },
    "other_stats": {
        c: c
        for c in ["crosses", "tackles_won", "interceptions", "fouls_drawn", "fouls_committed", "offsides",
                  "yellow_cards", "red_cards"]
    },
    "per90": {f.removesuffix("_per90"): f for f in FEATURES},
    "data_quality": {"similarity_eligible": "is_similarity_eligible", "sample_quality": "sample_quality"},
}
# What the similar-entity record says about its model.
MODEL = {"name": "player-similarity", "version": "2.0", "metric": "euclidean", "preprocessing": "standard_scaler"}
_BRIEF = {
    "canonical_player_key": "key", "name": "player_name", "club": "primary_squad_name",
    "competition": "primary_competition_name", "position": "position_raw", "position_group": "position_group",
    "minutes": "minutes", "stint_count": "stint_count",
}


def _profile_value(section: str, column: str) -> Column:
    if column == "age":
        return F.col(column).cast("int")
    return F.col(column).cast("double") if section == "per90" else F.col(column)


def profile_record() -> list[Column]:
    return [
        F.struct(*[_profile_value(name, src).alias(out) for out, src in fields.items()]).alias(name)
        for name, fields in PROFILE.items()
    ]


def profiles(resolved: DataFrame, canonical: DataFrame) -> DataFrame:
    """Profile sections for every resolved request; other requests keep only their outcome."""
    records = canonical.select(
        F.col("canonical_player_key").alias("matched_canonical_player_key"),
        F.col("season").alias("matched_season"), *profile_record(),
    )
    asked = resolved.select("request_id", "status", "status_code", "detail", "matched_canonical_player_key", "matched_season")
    return asked.join(records, ["matched_canonical_player_key", "matched_season"], "left").select(
        "request_id", "status", "status_code", "detail", *PROFILE
    )


def similar_records(outcomes: DataFrame, neighbours: DataFrame, space: Space) -> DataFrame:
    """Model, target and ranked neighbours per request; lists are no longer than the request's limit."""
    brief = [F.col(src).alias(out) for out, src in _BRIEF.items()]
    target = space.rows.select(target_id().alias("target_id"), F.struct(*brief).alias("player"))
    others = space.rows.select("key", "season", *[c for c in _BRIEF.values() if c != "key"])
    entry = F.struct("rank", *brief, F.round("score", 4).alias("distance"))
    lists = (
        neighbours.join(others, ["key", "season"])
        .groupBy("request_id")
        .agg(F.array_sort(F.collect_list(entry)).alias("similar_players"))
    )
    model = F.struct(*[F.lit(v).alias(n) for n, v in MODEL.items()]).alias("model")
    asked = outcomes.filter(F.col("status") == OK).select(
        "request_id", target_id("matched_canonical_player_key", "matched_season").alias("target_id")
    )
    return asked.join(target, "target_id").join(lists, "request_id", "left").select(
        "request_id", model, "player", F.coalesce("similar_players", F.array()).alias("similar_players")
    )


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DECIMALS) for c in columns})
