"""Land API documents into the star schema: dimensions, facts, raw documents and rejects."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from stintworks.functions.cleaning import strict_number
from stintworks.operators.merge import last_per_key, merge_by_key
from stintworks.plans.store import TableStore, join_changes
from stintworks.sources.api_documents import FACT_PATHS, picked, player_rows, statistic_rows
from stintworks.workspace import materialize

# Source code and endpoint of these documents.
SOURCE_CODE = "API_FOOTBALL"
ENDPOINT = "/players"
SOURCES = [
    (1, "API_FOOTBALL", "API-Football", "https://v3.football.api-sports.io"),
    (2, "KAGGLE_FBREF", "Kaggle - Football Players Stats (FBref-derived)", None),
]
SOURCE_SCHEMA = "id long, code string, name string, base_url string"
PLAYER = (
    "api_football_id int, name string, firstname string, lastname string, birth_date date, birth_place string, "
    "birth_country string, nationality string, height_cm smallint, weight_kg smallint, photo_url string, updated_at timestamp"
)
COMPETITION = "api_football_id int, name string, country string, type string, logo_url string, updated_at timestamp"
COMPETITION_SEASON = (
    "competition_id int, season int, start_date date, end_date date, is_current boolean, coverage string, updated_at timestamp"
)
TEAM = (
    "api_football_id int, name string, code string, country string, founded int, is_national boolean, "
    "logo_url string, updated_at timestamp"
)
FACT_KEYS = ["player_id", "competition_id", "team_id", "season", "source_id"]
FACT = (
    "player_id int, competition_id int, team_id int, source_id long, season int, "
    + ", ".join(f"{name} {kind}" for name, (_, kind) in FACT_PATHS.items())
    + ", fetched_at timestamp, updated_at timestamp"
)
RAW = (
    "source_id long, endpoint string, request_params string, entity_type string, entity_api_id int, season int, "
    "payload string, fetched_at timestamp"
)


class ApiLanding(NamedTuple):
    player: DataFrame
    competition: DataFrame
    competition_season: DataFrame
    team: DataFrame
    stats: DataFrame
    raw: DataFrame
    rejects: DataFrame
    summary: DataFrame


def source_registry(spark) -> DataFrame:
    return spark.createDataFrame(SOURCES, SOURCE_SCHEMA)


class Updates(NamedTuple):
    """What a landing changes in one table of the star schema."""

    rows: DataFrame
    schema: str
    keys: list[str]
    columns: list[str]
    order: list[str]


def star_updates(parsed: DataFrame, sources: DataFrame | None = None) -> tuple[dict[str, Updates], DataFrame, DataFrame, DataFrame]:
    """``(updates by table, raw documents, rejects, summary)`` of parsed documents (see ``picked``), stored before."""
    spark = parsed.sparkSession
    sources = source_registry(spark) if sources is None else sources
    accepted = parsed.filter(F.col("reject_reason").isNull())
    rejects = parsed.filter(F.col("reject_reason").isNotNull()).select(
        "document_id", "search", "league", "season", "reject_reason", "errors"
    )
    stats = statistic_rows(accepted)
    order = ["fetched_at", "document_id", "place"]
    stamp = F.col("fetched_at").alias("updated_at")

    people = player_rows(accepted).withColumn("updated_at", F.col("fetched_at"))
    named = [c for c in people.columns if c not in ("api_football_id", "fetched_at", "document_id")]
    leagues = stats.select(
        F.col("competition_api_id").alias("api_football_id"), F.col("competition_name").alias("name"),
        F.col("competition_country").alias("country"), F.col("competition_logo").alias("logo_url"), stamp, *order,
    )
    seasons = stats.select(
        F.col("competition_api_id").alias("competition_id"), "season", F.lit(False).alias("is_current"), stamp, *order
    )
    teams = stats.select(
        F.col("team_api_id").alias("api_football_id"), F.col("team_name").alias("name"),
        F.col("team_logo").alias("logo_url"), stamp, *order,
    )
    registered = sources.filter(F.col("code") == SOURCE_CODE).select("id").first()
    if registered is None:
        raise ValueError(f"source {SOURCE_CODE} is not registered")
    source_id = F.lit(registered["id"]).cast("long").alias("source_id")
    facts = stats.select(
        F.col("player_api_id").alias("player_id"), F.col("competition_api_id").alias("competition_id"),
        F.col("team_api_id").alias("team_id"), source_id, "season", *FACT_PATHS, "fetched_at", stamp,
        "document_id", "place",
    )
    updates = {
        "player": Updates(people, PLAYER, ["api_football_id"], named, ["fetched_at", "document_id"]),
        "competition": Updates(leagues, COMPETITION, ["api_football_id"], ["name", "country", "logo_url", "updated_at"], order),
        "competition_season": Updates(seasons, COMPETITION_SEASON, ["competition_id", "season"], ["updated_at"], order),
        "team": Updates(teams, TEAM, ["api_football_id"], ["name", "logo_url", "updated_at"], order),
        "stats": Updates(facts, FACT, FACT_KEYS, [*FACT_PATHS, "fetched_at", "updated_at"], order),
    }
    raw = accepted.select(
        source_id, F.lit(ENDPOINT).alias("endpoint"),
        F.to_json(F.struct("search", "league", "season")).alias("request_params"),
        F.lit("player").alias("entity_type"), strict_number(F.col("player.id"), "int").alias("entity_api_id"),
        "season", "payload", "fetched_at",
    )
    summary = stats.select(
        "document_id", "team_name", "competition_name", "season", "appearances", "minutes", "goals", "assists"
    )
    return updates, raw, rejects, summary


def land_api_documents(
    documents: DataFrame,
    requests: DataFrame,
    sources: DataFrame | None = None,
    existing: dict[str, DataFrame] | None = None,
) -> ApiLanding:
    """New versions of the star tables after landing ``documents``.

    ``documents`` has document_id, payload and fetched_at; ``requests`` has document_id, search,
    league and season. The natural keys of the source serve as dimension ids. A later document wins
    over an earlier one. A document that does not answer its request, or could not be loaded whole, is a
    reject with its reason, and so is a request without a document.
    """
    spark = documents.sparkSession
    existing = existing or {}
    # Parsing is the costly part and every table below starts from it: store it once.
    parsed = materialize(picked(documents, requests), "documents")
    updates, raw, rejects, summary = star_updates(parsed, sources)
    tables = {
        name: merge_by_key(existing[name] if name in existing else spark.createDataFrame([], u.schema), u.rows, u.keys, u.columns, u.order)
        for name, u in updates.items()
    }
    return ApiLanding(**tables, raw=raw, rejects=rejects, summary=summary)


def land_into_store(
    store: TableStore, documents: DataFrame, requests: DataFrame, sources: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Merge ``documents`` into the star tables of ``store``; ``(rejects, summary)``.

    Each table rewrites only the parts its new rows fall in; all five change together or not at all.
    """
    since = store.version()
    parsed = materialize(picked(documents, requests), "documents")
    updates, _, rejects, summary = star_updates(parsed, sources)
    changes = [
        store.stage_merge(name, u.schema, materialize(last_per_key(u.rows, u.keys, u.order), f"updates-{name}"), u.keys, u.columns)
        for name, u in updates.items()
    ]
    store.publish(join_changes(*changes), since)
    return rejects, summary


def star_table(store: TableStore, name: str) -> DataFrame:
    """A stored table of the star schema: player, competition, competition_season, team or stats."""
    schemas = {"player": PLAYER, "competition": COMPETITION, "competition_season": COMPETITION_SEASON, "team": TEAM, "stats": FACT}
    return store.read(name, schemas[name])


def append_raw(raw: DataFrame, path: str) -> None:
    raw.write.mode("append").partitionBy("season").parquet(path)


def latest_documents(raw: DataFrame) -> DataFrame:
    """Newest document per entity and season."""
    return last_per_key(raw, ["entity_type", "entity_api_id", "season"], ["fetched_at", "payload"])
