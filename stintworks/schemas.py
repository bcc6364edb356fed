"""Column lists and types of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Feature vector of the similarity model, in display order, with labels.
FEATURE_LABELS = {
    "non_penalty_goals_per90": "Non-penalty goals / 90",
    "assists_per90": "Assists / 90",
    "shots_per90": "Shots / 90",
    "shots_on_target_per90": "Shots on target / 90",
    "crosses_per90": "Crosses / 90",
    "fouls_drawn_per90": "Fouls drawn / 90",
    "tackles_won_per90": "Tackles won / 90",
    "interceptions_per90": "Interceptions / 90",
    "fouls_committed_per90": "Fouls committed / 90",
    "offsides_per90": "Offsides / 90",
}
FEATURES = list(FEATURE_LABELS)

# Features that matter per position group. Other groups have no role set.
ROLE_FEATURES = {
    "FW": ["non_penalty_goals_per90", "assists_per90", "shots_per90", "shots_on_target_per90",
           "fouls_drawn_per90", "offsides_per90"],
    "FW_MF": ["non_penalty_goals_per90", "assists_per90", "shots_per90", "shots_on_target_per90",
              "crosses_per90", "fouls_drawn_per90"],
    "MF": ["assists_per90", "shots_per90", "crosses_per90", "fouls_drawn_per90",
           "tackles_won_per90", "interceptions_per90"],
    "DF_MF": ["assists_per90", "crosses_per90", "fouls_drawn_per90", "tackles_won_per90",
              "interceptions_per90", "fouls_committed_per90"],
    "DF": ["crosses_per90", "fouls_drawn_per90", "tackles_won_per90", "interceptions_per90",
           "fouls_committed_per90"],
}

# Season CSV header -> (staging column, kind). Kinds: text, int, (precision, scale).
CSV_REQUIRED = {
    "Rk": ("source_rank", "int"),
    "Player": ("player_name", "text"),
    "Nation": ("nation_raw", "text"),
    "Pos": ("position_raw", "text"),
    "Squad": ("squad_name", "text"),
    "Comp": ("competition_raw", "text"),
    "Age": ("age", (5, 2)),
    "Born": ("born_year", "int"),
    "MP": ("appearances", "int"),
    "Starts": ("starts", "int"),
    "Min": ("minutes", "int"),
    "90s": ("nineties", (8, 2)),
    "Gls": ("goals", "int"),
    "Ast": ("assists", "int"),
    "G+A": ("goal_contributions", "int"),
    "G-PK": ("non_penalty_goals", "int"),
    "PK": ("penalties_scored", "int"),
    "PKatt": ("penalties_attempted", "int"),
    "CrdY": ("yellow_cards", "int"),
    "CrdR": ("red_cards", "int"),
    "G+A-PK": ("non_penalty_ga_per90", (8, 4)),
    "Sh": ("shots", "int"),
    "SoT": ("shots_on_target", "int"),
    "SoT%": ("shots_on_target_pct", (8, 3)),
    "Sh/90": ("shots_per90", (8, 3)),
    "SoT/90": ("shots_on_target_per90", (8, 3)),
    "G/Sh": ("goals_per_shot", (8, 4)),
    "G/SoT": ("goals_per_shot_on_target", (8, 4)),
    "Crs": ("crosses", "int"),
    "TklW": ("tackles_won", "int"),
    "Int": ("interceptions", "int"),
    "Fld": ("fouls_drawn", "int"),
    "Fls": ("fouls_committed", "int"),
    "Off": ("offsides", "int"),
    "2CrdY": ("second_yellow_cards", "int"),
    "OG": ("own_goals", "int"),
}
CSV_EXTRA = {
    "Mn/MP": ("minutes_per_appearance", (8, 2)),
    "Min%": ("minutes_pct", (8, 3)),
    "Mn/Start": ("minutes_per_start", (8, 2)),
    "Compl": ("complete_matches", "int"),
    "Subs": ("sub_appearances", "int"),
    "Mn/Sub": ("minutes_per_sub", (8, 2)),
    "unSub": ("unused_sub", "int"),
    "PPM": ("points_per_match", (8, 3)),
    "onG": ("on_goals", "int"),
    "onGA": ("on_goals_against", "int"),
    "+/-": ("plus_minus", (8, 2)),
    "+/-90": ("plus_minus_per90", (8, 3)),
    "On-Off": ("on_off_per90", (8, 3)),
    "GA": ("goals_against", "int"),
    "GA90": ("goals_against_per90", (8, 3)),
    "SoTA": ("shots_on_target_against", "int"),
    "Saves": ("saves", "int"),
    "Save%": ("save_pct", (8, 3)),
    "W": ("wins", "int"),
    "D": ("draws", "int"),
    "L": ("losses", "int"),
    "CS": ("clean_sheets", "int"),
    "CS%": ("clean_sheet_pct", (8, 3)),
    "PKatt_stats_keeper": ("keeper_penalty_attempts", "int"),
    "PKA": ("keeper_penalties_allowed", "int"),
    "PKsv": ("keeper_penalties_saved", "int"),
    "PKm": ("keeper_penalties_missed", "int"),
}
CSV_COLUMNS = {**CSV_REQUIRED, **CSV_EXTRA}

_KIND = {"text": T.StringType(), "int": T.IntegerType()}
_MEASURES = [
    T.StructField(name, _KIND[kind] if isinstance(kind, str) else T.DecimalType(*kind))
    for name, kind in CSV_COLUMNS.values()
    if kind != "text" and name != "source_rank"
]

# Row numbers are long: one file may hold more rows than an int can count.
STAGING = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("source_id", T.LongType()),
        T.StructField("source_row_number", T.LongType()),
        T.StructField("source_rank", T.IntegerType()),
        T.StructField("source_player_key", T.StringType()),
        T.StructField("player_name", T.StringType()),
        T.StructField("nation_raw", T.StringType()),
        T.StructField("nation_country_code", T.StringType()),
        T.StructField("nation_fifa_code", T.StringType()),
        T.StructField("position_raw", T.StringType()),
        T.StructField("squad_name", T.StringType()),
        T.StructField("competition_raw", T.StringType()),
        T.StructField("competition_source_code", T.StringType()),
        T.StructField("competition_name", T.StringType()),
        T.StructField("season", T.IntegerType()),
        T.StructField("season_label", T.StringType()),
    ]
    + _MEASURES
    + [T.StructField("payload", T.StringType()), T.StructField("imported_at", T.TimestampType())]
)

# Counting columns summed from stints into the canonical row.
SUMMED = [
    "appearances", "starts", "minutes", "goals", "assists", "goal_contributions",
    "non_penalty_goals", "penalties_scored", "penalties_attempted", "shots", "shots_on_target",
    "crosses", "tackles_won", "interceptions", "fouls_drawn", "fouls_committed", "offsides",
    "yellow_cards", "red_cards",
]

OVERRIDE_KEYS = ["source_player_key", "season", "squad_name", "competition_name"]
OVERRIDES = T.StructType(
    [
        T.StructField("source_player_key", T.StringType()),
        T.StructField("season", T.IntegerType()),
        T.StructField("squad_name", T.StringType()),
        T.StructField("competition_name", T.StringType()),
        T.StructField("canonical_player_key", T.StringType()),
        T.StructField("canonical_player_name", T.StringType()),
        T.StructField("resolution_reason", T.StringType()),
    ]
)

REQUESTS = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("club", T.StringType()),
        T.StructField("season", T.IntegerType()),
        T.StructField("k", T.IntegerType()),
    ]
)
