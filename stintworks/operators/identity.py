"""Identity overrides: build them, apply them, and report where one may be needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stintworks.functions.rates import POSITION_GROUPS, position_group
from stintworks.operators.canonical import joined_names
from stintworks.operators.merge import merge_by_key
from stintworks.schemas import OVERRIDE_KEYS
from stintworks.workspace import dealt, materialize

RULE_KEYS = ["player_name", "born_year", "nation_fifa_code", "squad_name"]
IDENTITY = RULE_KEYS[:3]
# Numbers that identities hash to: a list of them is small enough for Spark to broadcast, whatever the identities are.
_NUMBERS = 1 << 20


def narrowed(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without most of those whose ``keys`` do not occur in ``wanted``, for an exact join to move the fewer ones.

    No row that matches is lost: like keys hash to the same number. The numbers are stored, so their file size is known.
    """
    def number(c: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*c), F.lit(_NUMBERS)).alias("_number")

    # Keys compare as the type that the rows have.
    numbers = wanted.select(number([F.col(c).try_cast(rows.schema[c].dataType) for c in keys])).distinct()
    marked = rows.withColumn("_number", number([F.col(c) for c in keys]))
    return marked.join(materialize(numbers, "numbers"), "_number", "left_semi").drop("_number")


def build_overrides(
    stints: DataFrame, rules: DataFrame, existing: DataFrame | None = None
) -> DataFrame:
    """Override rows for every stint a rule names, unique on the four override keys.

    ``rules`` has ``RULE_KEYS`` plus ``canonical_player_key`` and ``resolution_reason``. With
    ``existing`` the new rows replace old ones that have the same keys.
    """
    rules = materialize(rules, "rules")
    matched = narrowed(stints, rules, IDENTITY).join(rules, RULE_KEYS)
    decided = F.struct(
        "canonical_player_key",
        F.col("player_name").alias("canonical_player_name"),
        "resolution_reason",
    )
    order = F.struct("imported_at", "batch_id", "source_row_number", "canonical_player_key")
    built = (
        matched.groupBy(*OVERRIDE_KEYS)
        .agg(F.max_by(decided, order).alias("decided"))
        .select(*OVERRIDE_KEYS, "decided.*")
    )
    if existing is None:
        return built
    return merge_by_key(
        existing, built, OVERRIDE_KEYS,
        ["canonical_player_key", "canonical_player_name", "resolution_reason"],
    )


def resolve_identity(stints: DataFrame, overrides: DataFrame) -> DataFrame:
    """Add canonical key and name and whether an override supplied them.

    The overrides of an entity and season, of which there are as many as it has squads, meet its stints as one list, so
    the stints shuffle by that pair alone: a fold of them finds its rows in one task and sends one row per pair on.
    ``stints`` is counted, to deal many of them over tasks that hold their rows in memory: store it first.
    """
    pair, place = OVERRIDE_KEYS[:2], OVERRIDE_KEYS[2:]
    entry = F.struct(
        *[F.col(c).alias(f"at_{c}") for c in place],
        F.col("canonical_player_key").alias("override_key"),
        F.col("canonical_player_name").alias("override_name"),
        F.lit(True).alias("overridden"),
    )
    count = stints.count()
    # Both sides of the join are dealt alike, or the smaller one would say over how many tasks.
    lists = dealt(overrides, count, *pair).groupBy(*pair).agg(F.collect_list(entry).alias("decisions"))
    here = F.filter("decisions", lambda d: (d[f"at_{place[0]}"] == stints[place[0]]) & (d[f"at_{place[1]}"] == stints[place[1]]))
    return dealt(stints, count, *pair).join(lists, pair, "left").select(
        *[stints[c] for c in stints.columns], F.explode_outer(here).alias("decided")
    ).select(
        *stints.columns,
        F.coalesce("decided.override_key", "source_player_key").alias("canonical_player_key"),
        F.coalesce("decided.override_name", "player_name").alias("canonical_player_name"),
        F.coalesce("decided.overridden", F.lit(False)).alias("identity_overridden"),
    )


def collision_report(stints: DataFrame) -> DataFrame:
    """Source keys seen with several squads and several position groups in one season."""
    group = position_group(F.col("position_raw"))
    known = [*POSITION_GROUPS, "UNKNOWN"]
    # One bit per group makes the group count a plain bitwise aggregate.
    bit = F.lit(0)
    for place, name in enumerate(known):
        bit = F.when(group == name, F.lit(1 << place)).otherwise(bit)
    return (
        stints.groupBy("source_player_key", "season")
        .agg(
            F.count(F.lit(1)).alias("stint_count"),
            F.size(F.collect_set("squad_name")).cast("long").alias("squad_count"),
            F.bit_count(F.bit_or(bit)).cast("long").alias("group_count"),
            joined_names("squad_name").alias("squad_names"),
        )
        .filter("squad_count > 1 AND group_count > 1")
    )
