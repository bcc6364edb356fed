"""API documents: nested JSON with one player's season statistics per league and team."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stintworks.functions.cleaning import bad_number, first_integer, strict_number, text_or_null

# Document paths under ``statistics`` per fact column, with the source's own spellings.
FACT_PATHS = {
    "position": ("games.position", "string"),
    "shirt_number": ("games.number", "int"),
    "appearances": ("games.appearences", "int"),
    "starts": ("games.lineups", "int"),
    "minutes": ("games.minutes", "int"),
    "rating": ("games.rating", "decimal(5,2)"),
    "substitutes_in": ("substitutes.in", "int"),
    "substitutes_out": ("substitutes.out", "int"),
    "substitutes_bench": ("substitutes.bench", "int"),
    "shots_total": ("shots.total", "int"),
    "shots_on": ("shots.on", "int"),
    "goals": ("goals.total", "int"),
    "goals_conceded": ("goals.conceded", "int"),
    "assists": ("goals.assists", "int"),
    "saves": ("goals.saves", "int"),
    "passes_total": ("passes.total", "int"),
    "passes_key": ("passes.key", "int"),
    "pass_accuracy_pct": ("passes.accuracy", "decimal(5,2)"),
    "tackles_total": ("tackles.total", "int"),
    "blocks": ("tackles.blocks", "int"),
    "interceptions": ("tackles.interceptions", "int"),
    "duels_total": ("duels.total", "int"),
    "duels_won": ("duels.won", "int"),
    "dribbles_attempts": ("dribbles.attempts", "int"),
    "dribbles_success": ("dribbles.success", "int"),
    "dribbles_past": ("dribbles.past", "int"),
    "fouls_drawn": ("fouls.drawn", "int"),
    "fouls_committed": ("fouls.committed", "int"),
    "cards_yellow": ("cards.yellow", "int"),
    "cards_yellow_red": ("cards.yellowred", "int"),
    "cards_red": ("cards.red", "int"),
    "penalties_won": ("penalty.won", "int"),
    "penalties_committed": ("penalty.commited", "int"),
    "penalties_scored": ("penalty.scored", "int"),
    "penalties_missed": ("penalty.missed", "int"),
    "penalties_saved": ("penalty.saved", "int"),
}
# What an ``errors`` member looks like when there is no error.
NO_ERRORS = ["", "[]", "{}", "null", "false", "0"]


def _text_struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _statistics_type() -> T.StructType:
    groups: dict[str, list[str]] = {"league": ["id", "name", "country", "logo", "season"], "team": ["id", "name", "logo"]}
    for path, _ in FACT_PATHS.values():
        group, name = path.split(".")
        groups.setdefault(group, []).append(name)
    return T.StructType([T.StructField(g, _text_struct(*names)) for g, names in groups.items()])


# Cells are read as text, numbers included, and cleaned one by one.
PLAYER_TYPE = _text_struct("id", "name", "firstname", "lastname", "nationality", "height", "weight", "photo").add(
    "birth", _text_struct("date", "place", "country")
)
DOCUMENT_TYPE = T.StructType(
    [
        T.StructField(
            "response",
            T.ArrayType(
                T.StructType(
                    [T.StructField("player", PLAYER_TYPE), T.StructField("statistics", T.ArrayType(_statistics_type()))]
                )
            ),
        )
    ]
)


def read_api_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: document_id (file name), payload text and file time as fetched_at."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -1)).alias("document_id"),
        F.col("value").alias("payload"),
        F.col("_metadata.file_modification_time").alias("fetched_at"),
    )


def write_api_containers(documents: DataFrame, path: str, documents_per_file: int = 10_000) -> None:
    """Write ``document_id, payload, fetched_at`` as containers: many documents to a file, one JSON object to a line."""
    line = F.to_json(F.struct("document_id", "fetched_at", "payload"))
    documents.select(line.alias("value")).write.option("maxRecordsPerFile", documents_per_file).text(path)


def read_api_containers(spark: SparkSession, path: str) -> DataFrame:
    """One row per line: document_id, payload, fetched_at, and the ``container`` (file name) it came from.

    A line is parsed once, as a variant, and its members are taken from that. A payload may be text or JSON itself. A
    line without a name takes the container's; one that is no JSON is a document of its own text, to be rejected later.
    """
    lines = spark.read.text(path).select(
        F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -1)).alias("container"),
        F.col("_metadata.file_modification_time").alias("changed"), "value", F.try_parse_json("value").alias("line"),
    )

    def member(name: str, kind: str) -> Column:
        return F.try_variant_get("line", f"$.{name}", kind)

    return lines.select(
        F.coalesce(member("document_id", "string"), F.col("container")).alias("document_id"),
        F.coalesce(member("payload", "string"), F.col("value")).alias("payload"),
        F.coalesce(member("fetched_at", "timestamp"), F.col("changed")).alias("fetched_at"),
        "container",
    )


def wildcard(search: Column) -> Column:
    """Regular expression for a text that contains ``search``; ``*``, ``?`` and ``[..]`` are wildcards."""
    quoted = F.regexp_replace(search, r"([\\.+^$(){}|])", r"\\$1")
    return F.concat(F.lit("(?is)^.*"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit(".*$"))


def picked(documents: DataFrame, requests: DataFrame) -> DataFrame:
    """Documents with their request, the entry it means, its matching statistics and a reject reason.

    All of it happens inside the row: a document is never exploded before it is accepted. A document
    that nobody asked for, and a request without a document, are rows with a reason as well. What
    would stop a load (a missing key or name, a cell that is no number) rejects the document.
    """
    come = documents.withColumn("has_document", F.lit(True))
    joined = come.join(requests.withColumn("has_request", F.lit(True)), "document_id", "full_outer").withColumns(
        {
            "entries": F.from_json("payload", DOCUMENT_TYPE).getField("response"),
            "errors": F.coalesce(F.trim(F.get_json_object("payload", "$.errors")), F.lit("")),
            "pattern": wildcard(F.col("search")),
        }
    )
    named = F.filter("entries", lambda e: F.coalesce(F.regexp_like(e["player"]["name"], F.col("pattern")), F.lit(False)))
    entry = F.coalesce(F.get(named, F.lit(0)), F.get("entries", F.lit(0)))
    chosen = joined.withColumn("entry", entry)

    def asked_for(s: Column) -> Column:
        league = strict_number(s["league"]["id"], "long") == F.col("league")
        return F.coalesce(league & (strict_number(s["league"]["season"], "int") == F.col("season")), F.lit(False))

    chosen = chosen.withColumn("statistics", F.filter(F.coalesce(F.col("entry.statistics"), F.array().cast(T.ArrayType(_statistics_type()))), asked_for))
    person = F.col("entry.player")
    numbers = [(path.split("."), kind) for path, kind in FACT_PATHS.values() if kind != "string"]
    numbers += [(["league", "id"], "int"), (["league", "season"], "int"), (["team", "id"], "int")]

    def unreadable(s: Column) -> Column:
        return reduce(or_, [bad_number(s[group][name], kind) for (group, name), kind in numbers])

    def unnamed(s: Column) -> Column:
        keys = strict_number(s["league"]["id"], "int").isNull() | strict_number(s["team"]["id"], "int").isNull()
        return keys | text_or_null(s["team"]["name"]).isNull() | text_or_null(s["league"]["name"]).isNull()

    reason = (
        F.when(F.col("has_document").isNull(), "NO_DOCUMENT")
        .when(F.col("has_request").isNull(), "NO_REQUEST")
        .when(~F.col("errors").isin(NO_ERRORS), "API_ERRORS")
        .when(F.coalesce(F.size("entries"), F.lit(0)) <= 0, "NO_ENTRIES")
        .when(F.size("statistics") <= 0, "NO_STATISTICS")
        .when(bad_number(person["id"], "int") | F.exists("statistics", unreadable), "BAD_NUMBER")
        .when(strict_number(person["id"], "int").isNull() | text_or_null(person["name"]).isNull(), "NO_PLAYER_KEY")
        .when(F.exists("statistics", unnamed), "NO_DIMENSION_KEY")
    )
    return chosen.withColumn("reject_reason", reason).select(
        "document_id", "payload", "fetched_at", "search", "league", "season", "errors", "reject_reason",
        F.col("entry.player").alias("player"), "statistics",
    )


def player_rows(accepted: DataFrame) -> DataFrame:
    p = F.col("player")
    return accepted.select(
        strict_number(p["id"], "int").alias("api_football_id"),
        *[text_or_null(p[c]).alias(c) for c in ("name", "firstname", "lastname")],
        text_or_null(p["birth"]["date"]).try_cast("date").alias("birth_date"),
        text_or_null(p["birth"]["place"]).alias("birth_place"),
        text_or_null(p["birth"]["country"]).alias("birth_country"),
        text_or_null(p["nationality"]).alias("nationality"),
        first_integer(p["height"], "smallint").alias("height_cm"),
        first_integer(p["weight"], "smallint").alias("weight_kg"),
        text_or_null(p["photo"]).alias("photo_url"),
        "fetched_at", "document_id",
    )


def statistic_rows(accepted: DataFrame) -> DataFrame:
    """One row per accepted statistic: keys, dimension attributes and 36 measures."""
    rows = accepted.select(
        "document_id", "fetched_at", strict_number(F.col("player")["id"], "int").alias("player_api_id"),
        F.posexplode("statistics").alias("place", "s"),
    )

    def measure(path: str, kind: str) -> Column:
        group, name = path.split(".")
        cell = F.col("s")[group][name]
        return text_or_null(cell) if kind == "string" else strict_number(cell, kind)

    return rows.select(
        "document_id", "fetched_at", "place", "player_api_id",
        strict_number(F.col("s.league.id"), "int").alias("competition_api_id"),
        text_or_null(F.col("s.league.name")).alias("competition_name"),
        text_or_null(F.col("s.league.country")).alias("competition_country"),
        text_or_null(F.col("s.league.logo")).alias("competition_logo"),
        strict_number(F.col("s.league.season"), "int").alias("season"),
        strict_number(F.col("s.team.id"), "int").alias("team_api_id"),
        text_or_null(F.col("s.team.name")).alias("team_name"),
        text_or_null(F.col("s.team.logo")).alias("team_logo"),
        *[measure(path, kind).alias(out) for out, (path, kind) in FACT_PATHS.items()],
    )
