"""Analysis views over the star schema and over single stints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stintworks.functions.rates import (
    pct, per90, position_group, ratio, role_family, sample_quality, stint_eligible,
)

# Columns of the stint-level base, in order.
BASE_COLUMNS = [
    "id", "batch_id", "source_id", "source_player_key", "player_name", "nation_raw", "nation_country_code",
    "nation_fifa_code", "position_raw", "position_group", "squad_name", "competition_name", "season",
    "season_label", "age", "born_year", "appearances", "starts", "minutes", "nineties", "goals", "assists",
    "goal_contributions", "non_penalty_goals", "penalties_scored", "penalties_attempted", "yellow_cards",
    "red_cards", "shots", "shots_on_target", "shots_on_target_pct", "shots_per90", "shots_on_target_per90",
    "goals_per_shot", "goals_per_shot_on_target", "crosses", "tackles_won", "interceptions", "fouls_drawn",
    "fouls_committed", "offsides", "minutes_per_appearance", "minutes_pct", "minutes_per_start",
    "complete_matches", "sub_appearances", "minutes_per_sub", "points_per_match", "plus_minus",
    "plus_minus_per90", "on_off_per90", "goals_against", "goals_against_per90", "shots_on_target_against",
    "saves", "save_pct", "wins", "draws", "losses", "clean_sheets", "clean_sheet_pct",
    "keeper_penalty_attempts", "keeper_penalties_allowed", "keeper_penalties_saved",
    "keeper_penalties_missed", "imported_at",
]
# Measures with a rate per 90 minutes on single stints.
STINT_RATES = [
    "goals", "assists", "goal_contributions", "non_penalty_goals", "crosses", "tackles_won", "interceptions",
    "fouls_drawn", "fouls_committed", "offsides", "yellow_cards", "red_cards", "saves",
    "shots_on_target_against", "clean_sheets",
]
# Columns the star view passes through.
STAR_STATS = [
    "season", "position", "appearances", "starts", "minutes", "rating", "goals", "assists", "penalties_scored",
    "penalties_missed", "shots_total", "shots_on", "passes_total", "passes_key", "duels_total", "duels_won",
    "dribbles_attempts", "dribbles_success",
]


def intelligence_base(staging: DataFrame) -> DataFrame:
    """Normalised stints with group, role family, eligibility, quality band and 15 rates."""
    grouped = staging.withColumn("position_group", position_group(F.col("position_raw")))
    group, minutes = F.col("position_group"), F.col("minutes")
    return grouped.select(
        *BASE_COLUMNS,
        role_family(group).alias("role_family"),
        stint_eligible(minutes, group).alias("is_similarity_eligible"),
        sample_quality(minutes).alias("sample_quality"),
        *[per90(m).alias(f"{m}_per90") for m in STINT_RATES],
    )


def season_analysis(
    stats: DataFrame, player: DataFrame, team: DataFrame, competition: DataFrame
) -> DataFrame:
    """Facts joined with their dimensions, plus per-90 rates, percentages and ratios."""
    p = player.select(F.col("id").alias("player_id"), "api_football_id", F.col("name").alias("player_name"), "nationality")
    t = team.select(F.col("id").alias("team_id"), F.col("name").alias("team_name"))
    c = competition.select(
        F.col("id").alias("competition_id"), F.col("name").alias("competition_name"),
        F.col("country").alias("competition_country"),
    )

    def whole(name: str):
        return F.coalesce(F.col(name), F.lit(0))

    facts = stats.withColumns(
        {
            "goal_contributions": whole("goals") + whole("assists"),
            "non_penalty_goals": whole("goals") - whole("penalties_scored"),
        }
    )
    # A missing measure stays missing here, unlike in the stint-level base.
    rate = {
        "goals_per_90": "goals", "assists_per_90": "assists", "goal_contributions_per_90": "goal_contributions",
        "shots_per_90": "shots_total", "shots_on_per_90": "shots_on",
        "non_penalty_goals_per_90": "non_penalty_goals", "key_passes_per_90": "passes_key",
    }
    shares = {
        "shots_on_pct": ("shots_on", "shots_total"), "goal_conversion_pct": ("goals", "shots_total"),
        "dribble_success_pct": ("dribbles_success", "dribbles_attempts"), "duels_won_pct": ("duels_won", "duels_total"),
    }
    return (
        facts.join(p, "player_id").join(t, "team_id").join(c, "competition_id")
        .select(
            "player_id", "api_football_id", "player_name", "nationality", "team_id", "team_name",
            "competition_id", "competition_name", "competition_country", *STAR_STATS,
            *[per90(m, scale=2, null_as_zero=False).alias(out) for out, m in rate.items()],
            "goal_contributions", "non_penalty_goals",
            *[pct(a, b).alias(out) for out, (a, b) in shares.items()],
            ratio(F.col("minutes"), F.col("goals"), 2).alias("minutes_per_goal"),
        )
    )
