"""Staging rows, overrides and requests derived from the order tables.

One stint is (customer, year of order, supplier nation); see ``FIXTURES.md`` for the mapping.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stintworks.functions.cleaning import first_token, rest_after_first_token, source_key
from stintworks.operators.identity import build_overrides, narrowed, resolve_identity
from stintworks.operators.canonical import canonical
from stintworks.operators.cohorts import COHORT
from stintworks.operators.similarity import Space, build_space
from stintworks.plans.api_landing import ApiLanding, land_api_documents
from stintworks.plans.season_landing import Landing, land_season_csv
from stintworks.schemas import CSV_COLUMNS, STAGING
from stintworks.workspace import dealt, materialize, new_path

# Raw position text of each entity by its number modulo 20.
POSITIONS = ["GK", "FW", "FW", "FW", "FW", "FW,MF", "MF,FW", "MF", "MF", "MF", "DF,MF", "MF,DF",
             "DF", "DF", "DF", "DF", "DF,FW", "FW,DF", "", None]


_LAYERS: dict[tuple[str, str, str], DataFrame] = {}
_SPACES: dict[tuple[str, str, tuple[str, ...]], Space] = {}


def layer(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stored layer: written once per application, read by every query built on it."""
    slot = (spark.sparkContext.applicationId, sf_dir, name)
    if slot not in _LAYERS:
        _LAYERS[slot] = materialize(build(), name)
    return _LAYERS[slot]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hits(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with the identity columns; one name in ten is shared by two."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k = F.col("k")
    block = F.expr("k div 10")
    named = customer.select(
        F.col("c_custkey").alias("k"),
        F.when(F.col("c_custkey") % 10 == 9, F.col("c_custkey") - 9)
        .otherwise(F.col("c_custkey"))
        .alias("named_after"),
    )
    names = customer.select(F.col("c_custkey").alias("named_after"), F.col("c_name").alias("player_name"))
    born = (F.lit(1975) + block % 20).cast("int")
    nation = F.format_string("n%d NAT%d", block % 25, block % 25)
    position = F.get(F.array(*[F.lit(p) for p in POSITIONS]), (k % 20).cast("int"))
    return named.join(names, "named_after").select(
        "k",
        "player_name",
        born.alias("born_year"),
        nation.alias("nation_raw"),
        first_token(nation).alias("nation_country_code"),
        rest_after_first_token(nation).alias("nation_fifa_code"),
        position.alias("position_raw"),
        source_key(F.col("player_name"), born.cast("string"), nation).alias("source_player_key"),
    )


def squads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(suppliers, sides)``: the side of each supplier by number, and what a side is: squad (nation) with its place
    by name, and competition (region). Lines carry the number only; both tables are small beside them."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    # The nations are a fixed list of 25 rows; ranking them by name needs no partitioning.
    placed = nation.withColumn("place", F.row_number().over(Window.orderBy("n_name")))
    pairs = placed.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    side = F.dense_rank().over(Window.orderBy("place", "r_name"))
    pairs = materialize(pairs.select("n_nationkey", "place", "n_name", "r_name", side.alias("side")), "sides")
    sides = pairs.select("side", "place", F.col("n_name").alias("squad_name"), F.col("r_name").alias("competition_name")).distinct()
    suppliers = table(spark, sf_dir, "supplier").join(pairs, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "side")
    # Stored, so that their file size says whether the lines need a shuffle to meet them.
    return materialize(suppliers, "suppliers"), materialize(sides, "squads")


def derive_stints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staging rows. Lines are folded per (order, side) first: distinct orders become row counts.

    Lines and orders meet by order, stints and entities by customer: the folds work where the rows are then, so each
    row goes over the network once per key, and narrow: flags of a line are bits of one number.
    """
    suppliers, sides = squads(spark, sf_dir)
    quantity = F.col("l_quantity")
    flagged = {
        "goals": F.col("l_returnflag") == "R",
        "non_penalty_goals": (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"),
        "assists": F.col("l_returnflag") == "A",
        "shots_on_target": F.col("l_linestatus") == "O",
        "fouls_drawn": quantity >= 25,
        "fouls_committed": quantity < 10,
        "tackles_won": F.col("l_discount") >= 0.05,
        "interceptions": F.col("l_tax") >= 0.04,
        "yellow_cards": quantity >= 45,
        "red_cards": quantity == 50,
    }
    bits = sum((F.when(hit, 1 << i).otherwise(0) for i, hit in enumerate(flagged.values())), F.lit(0))
    lines = table(spark, sf_dir, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        "l_orderkey", "side", "l_quantity", "l_linenumber", bits.alias("bits")
    )
    total = table(spark, sf_dir, "lineitem").count()  # no fold below has more rows
    per_order = dealt(lines.filter("l_orderkey IS NOT NULL").repartition("l_orderkey"), total, "l_orderkey").groupBy("l_orderkey", "side").agg(
        F.sum(quantity).alias("quantity"),
        F.count(F.lit(1)).alias("lines"),
        F.sum("l_linenumber").alias("crosses"),
        *[F.sum(F.getbit("bits", F.lit(i)).cast("int")).alias(name) for i, name in enumerate(flagged)],
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("k"),
        F.year("o_orderdate").alias("season"),
        (F.col("o_orderstatus") == "F").alias("finished"),
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
    )
    with_order = per_order.join(orders.filter("k IS NOT NULL"), F.col("l_orderkey") == F.col("o_orderkey"))
    per_stint = (
        dealt(with_order.drop("l_orderkey", "o_orderkey").repartition("k"), total, "k")
        .groupBy("k", "season", "side")
        .agg(
            F.count(F.lit(1)).alias("appearances"),
            _hits(F.col("finished")).alias("starts"),
            F.sum("quantity").alias("quantity"),
            F.sum("lines").alias("shots"),
            F.sum(F.when(F.col("urgent"), F.col("lines")).otherwise(0)).alias("offsides"),
            *[F.sum(c).alias(c) for c in ("crosses", *flagged)],
        )
    )
    k = F.col("k")
    row_number = (k * 10000 + F.col("season")) * 100 + F.col("place")
    penalties = F.col("goals") - F.col("non_penalty_goals")
    full = per_stint.join(entities(spark, sf_dir), "k").join(sides, "side").withColumns(
        {
            "id": row_number,
            "source_row_number": row_number,
            "season_label": F.col("season").cast("string"),
            "age": F.col("season") - F.col("born_year"),
            "minutes": F.when(k % 50 != 7, (F.col("quantity") * 10).cast("long")),
            "goal_contributions": F.col("goals") + F.col("assists"),
            "penalties_scored": penalties,
            "penalties_attempted": penalties,
        }
    )
    # Rows of one entity and season lie together in the files: its keys are stored and sent on once.
    return full.sortWithinPartitions("k", "season").select(
        *[
            (F.col(f.name) if f.name in full.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in STAGING.fields
        ]
    )


def stints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "staging", lambda: derive_stints(spark, sf_dir))


def collision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that tell apart the customers who share a name, birth year and nation.

    Half of the shared identities get rules; the squad decides which person is meant.
    """
    identity = ["player_name", "born_year", "nation_fifa_code"]
    shared = (
        entities(spark, sf_dir)
        .filter(F.expr("(k div 10) % 2 = 0"))
        .groupBy(*identity, "source_player_key")
        .agg(F.count(F.lit(1)).alias("persons"))
        .filter("persons > 1")
    )
    shared = materialize(shared, "shared")
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("squad_name"), "n_nationkey")
    seen = narrowed(stints(spark, sf_dir).select(*identity, "squad_name"), shared, identity).distinct()
    side = F.when(F.col("n_nationkey") < 13, ":A").otherwise(":B")
    return (
        seen.join(shared, identity)
        .join(nation, "squad_name")
        .select(
            *identity,
            "squad_name",
            F.concat("source_player_key", side).alias("canonical_player_key"),
            F.lit("shared name, birth year and nation").alias("resolution_reason"),
        )
    )


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = collision_rules(spark, sf_dir)
    return layer(spark, sf_dir, "overrides", lambda: build_overrides(stints(spark, sf_dir), rules))


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_identity(stints(spark, sf_dir), overrides(spark, sf_dir))


def canonical_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "canonical", lambda: canonical(resolved(spark, sf_dir)))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per order: exact, shouted, with a club, shortened, unknown, or without season."""
    people = entities(spark, sf_dir).select(F.col("k").alias("o_custkey"), "player_name")
    clubs = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    kind = F.col("o_orderkey") % 6
    turn = F.expr("o_orderkey div 6")
    name = F.col("player_name")
    asked = (
        F.when(kind == 1, F.concat(F.lit("  "), F.upper(name), F.lit(" ")))
        .when(kind == 3, F.substring(name, F.lit(1), F.length(name) - 2))
        .when(kind == 4, F.concat(name, F.lit(" x")))
        .otherwise(name)
    )
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
        .join(people, "o_custkey")
        .join(clubs, F.col("n_nationkey") == turn % 25)
        .select(
            F.col("o_orderkey").alias("request_id"),
            asked.alias("name"),
            F.when(kind == 2, F.col("n_name")).alias("club"),
            F.when(kind != 5, F.col("year")).alias("season"),
            (turn % 52).cast("int").alias("k"),
        )
    )


def named_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests with a neighbour's rank and a candidate's name instead of a limit."""
    names = entities(spark, sf_dir).select(F.col("k").alias("candidate_k"), F.col("player_name").alias("candidate"))
    asked = requests(spark, sf_dir).drop("k").withColumn("rank", (F.col("request_id") % 90 + 1).cast("int"))
    return asked.withColumn("candidate_k", F.col("request_id") % 40 + 1).join(names, "candidate_k").drop("candidate_k")


def similarity_space(spark: SparkSession, sf_dir: str, cohort_cols: tuple[str, ...] = COHORT) -> Space:
    """Standardised population, stored once per application and cohort definition."""
    slot = (spark.sparkContext.applicationId, sf_dir, cohort_cols)
    if slot not in _SPACES:
        _SPACES[slot] = build_space(canonical_layer(spark, sf_dir), cohort_cols)
    return _SPACES[slot]


def star(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(stats, player, team, competition)`` of the star schema, one fact row per stint."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    home = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nationality"))
    player = table(spark, sf_dir, "customer").join(home, "c_nationkey").select(
        F.col("c_custkey").alias("id"), F.col("c_custkey").cast("int").alias("api_football_id"),
        F.col("c_name").alias("name"), "nationality",
    )
    team = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    competition = region.select(
        F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"),
        F.lit(None).cast("string").alias("country"),
    )
    k = F.expr("id div 1000000")
    teams = team.select(F.col("id").alias("team_id"), F.col("name").alias("squad_name"))
    leagues = competition.select(F.col("id").alias("competition_id"), F.col("name").alias("competition_name"))
    sparse = F.when(k % 7 != 0, F.col("crosses"))
    stats = (
        stints(spark, sf_dir)
        .join(teams, "squad_name")
        .join(leagues, "competition_name")
        .select(
            k.alias("player_id"), "team_id", "competition_id", F.lit(1).cast("long").alias("source_id"), "season",
            F.col("position_raw").alias("position"), "appearances", "starts", "minutes",
            (F.lit(6) + F.col("starts") / F.lit(4)).cast("decimal(5,2)").alias("rating"),
            F.when(k % 11 != 0, F.col("goals")).alias("goals"), "assists", "penalties_scored",
            (F.col("penalties_attempted") - F.col("penalties_scored")).alias("penalties_missed"),
            F.col("shots").alias("shots_total"), F.col("shots_on_target").alias("shots_on"),
            (F.col("crosses") * 3).alias("passes_total"), sparse.alias("passes_key"),
            (F.col("fouls_drawn") + F.col("fouls_committed")).alias("duels_total"),
            F.col("fouls_drawn").alias("duels_won"),
            (F.col("tackles_won") + F.col("interceptions")).alias("dribbles_attempts"),
            F.col("tackles_won").alias("dribbles_success"),
        )
    )
    return stats, player, team, competition


def named_candidates(targets: DataFrame, space: Space) -> DataFrame:
    """Targets that ask for the first name of their own cohort in capitals, or for an unknown one."""
    first = space.rows.groupBy("cohort").agg(F.min("player_name").alias("first_name"))
    asked = F.when(F.col("season") % 2 == 0, F.concat(F.upper("first_name"), F.lit(" "))).otherwise("nobody")
    return targets.join(first, "cohort").withColumn("candidate_name", asked).drop("first_name")


def season_csv_cells(staging: DataFrame) -> list[Column]:
    """The columns of the season CSV as text, with the untidy number formats of the source."""
    text = {name: F.col(target).cast("string") for name, (target, _) in CSV_COLUMNS.items() if target in staging.columns}
    text |= {
        "Comp": F.concat(F.lit("c "), F.col("competition_name")),
        "Min": F.format_number("minutes", 0),
        "Age": F.concat(F.col("age"), F.lit(" ")),
        "Gls": F.concat(F.col("goals"), F.lit(".0")),
        "SoT%": F.concat((F.col("shots_on_target") * 100 / F.col("shots")).cast("decimal(8,1)"), F.lit("%")),
        "+/-": F.concat(F.lit("+"), F.col("goals")),
        "onG": F.lit("n/a"),
    }
    return [text[c].alias(c) for c in CSV_COLUMNS]


def write_season_csv(spark: SparkSession, staging: DataFrame) -> str:
    path = new_path(spark, "season-csv-source")
    staging.select(*season_csv_cells(staging)).write.option("header", True).csv(path)
    return path


def season_csv_part(spark: SparkSession, sf_dir: str, part: str) -> str:
    """The season CSV of the stints in Europe, or of all others."""
    europe = F.col("competition_name") == "EUROPE"
    chosen = stints(spark, sf_dir).filter(europe if part == "europe" else ~europe)
    return layer_path(spark, sf_dir, f"season-csv-{part}", lambda: write_season_csv(spark, chosen))


def ragged_season_csv(spark: SparkSession, sf_dir: str) -> str:
    """The season CSV with a cell too many in one record of fifty and three too few in another."""
    rows = stints(spark, sf_dir)
    names = list(CSV_COLUMNS)
    header = ",".join(names)

    def quoted(c: Column) -> Column:
        text = F.coalesce(c, F.lit(""))
        return F.when(F.contains(text, F.lit(",")), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)

    cells = F.array(*[quoted(c) for c in season_csv_cells(rows)])
    kind = F.col("id") % 50
    line = F.when(kind == 3, F.concat(F.array_join(cells, ","), F.lit(",extra"))).when(
        kind == 4, F.array_join(F.slice(cells, 1, len(names) - 3), ",")
    ).otherwise(F.array_join(cells, ","))

    def with_header(batches):
        import pandas as pd

        for number, batch in enumerate(batches):
            yield pd.concat([pd.DataFrame({"value": [header]}), batch]) if number == 0 else batch

    def write() -> str:
        path = new_path(spark, "season-csv-ragged")
        rows.select(line.alias("value")).mapInPandas(with_header, "value string").write.text(path)
        return path

    return layer_path(spark, sf_dir, "season-csv-ragged", write)


def season_csv_source(spark: SparkSession, sf_dir: str) -> str:
    return layer_path(spark, sf_dir, "season-csv", lambda: write_season_csv(spark, stints(spark, sf_dir)))


_LANDED: dict[tuple[str, str], Landing] = {}
_API_LANDED: dict[tuple[str, str], ApiLanding] = {}


def landed(spark: SparkSession, sf_dir: str) -> Landing:
    """The CSV text landed as one batch per file, once per application, under folders of its own."""
    slot = (spark.sparkContext.applicationId, sf_dir)
    if slot not in _LANDED:
        staging_dir, batches_dir = new_path(spark, "landed-staging"), new_path(spark, "landed-batches")
        source = season_csv_source(spark, sf_dir)
        _LANDED[slot] = land_season_csv(spark, source, 2025, "2025/26", staging_dir, batches_dir, source_id=2)
    return _LANDED[slot]


def api_landing(spark: SparkSession, sf_dir: str) -> ApiLanding:
    """The documents landed once per application."""
    slot = (spark.sparkContext.applicationId, sf_dir)
    if slot not in _API_LANDED:
        _API_LANDED[slot] = land_api_documents(*api_documents(spark, sf_dir))
    return _API_LANDED[slot]


_PATHS: dict[tuple[str, str, str], str] = {}


def layer_path(spark: SparkSession, sf_dir: str, name: str, write: Callable[[], str]) -> str:
    slot = (spark.sparkContext.applicationId, sf_dir, name)
    if slot not in _PATHS:
        _PATHS[slot] = write()
    return _PATHS[slot]


def api_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(documents, requests)``, stored like downloaded documents are."""
    documents, requests = derive_api_documents(spark, sf_dir)
    return layer(spark, sf_dir, "documents", lambda: documents), requests


def derive_api_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One JSON document per order, some without entries or with errors."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    lines = lines.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    per_team = lines.groupBy("l_orderkey", "n_nationkey", "n_name", "r_regionkey", "r_name").agg(
        F.count(F.lit(1)).alias("games"), F.sum("l_quantity").cast("long").alias("minutes"), _hits(F.col("l_returnflag") == "R").alias("goals"),
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", F.year("o_orderdate").alias("season"), (F.col("o_orderkey") % 10).alias("kind")
    )
    orders = orders.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    statistic = F.struct(
        F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("World").alias("country"), "season").alias("league"),
        F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("").alias("logo")).alias("team"),
        F.struct(F.lit("Attacker").alias("position"), F.lit(" 7 ").alias("number"), F.col("games").alias("appearences"),
                 "minutes", F.lit("6.755").alias("rating")).alias("games"),
        F.struct(F.col("goals").alias("total")).alias("goals"),
        F.struct(F.col("games").alias("commited")).alias("penalty"),
    )
    # An order has a handful of lines, so its list of statistics is short.
    whole = per_team.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        "o_orderkey", "o_custkey", "o_orderdate", "season", "kind", "c_name"
    ).agg(F.collect_list(statistic).alias("statistics"))
    player = F.struct(
        F.col("o_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("  ").alias("firstname"),
        F.concat((F.col("o_custkey") % 50 + 150).cast("string"), F.lit(" cm")).alias("height"),
        F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).alias("birth"),
    )
    entry = F.struct(player.alias("player"), F.col("statistics"))
    decoy = F.struct(
        F.struct(
            (F.col("o_custkey") + 1000000).alias("id"), F.lit("Somebody Else").alias("name"), F.lit("").alias("firstname"),
            F.lit("").alias("height"), F.struct(F.lit("").alias("date")).alias("birth"),
        ).alias("player"),
        F.col("statistics"),
    )
    entries = F.when(F.col("kind") == 1, F.slice(F.array(entry), 1, 0)).when(F.col("kind") == 2, F.array(decoy, entry)).otherwise(F.array(entry))
    errors = F.when(F.col("kind") == 0, '{"errors":{"token":"expired"},').otherwise('{"errors":[],')
    payload = F.concat(errors, F.regexp_replace(F.to_json(F.struct(entries.alias("response"))), r"^\{", ""))
    documents = whole.select(
        F.col("o_orderkey").cast("string").alias("document_id"), payload.alias("payload"), F.col("o_orderdate").cast("timestamp").alias("fetched_at")
    )
    requests = orders.select(
        F.col("o_orderkey").cast("string").alias("document_id"), F.lower(F.substring("c_name", 1, 8)).alias("search"),
        (F.col("o_orderkey") % 5).alias("league"), "season",
    )
    return documents, requests


def untidy_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys with one number text each, in ten spellings."""
    k = F.col("o_custkey")
    text = k.cast("string")
    spellings = [
        text, F.concat(F.lit(" "), text, F.lit(".7")), F.concat(F.lit("-"), text, F.lit(".7 ")), F.format_number(k, 0),
        F.concat(F.lit("+"), text), F.lit("  "), F.lit("abc"), F.concat(text, F.lit("%")),
        F.concat(F.lit("("), text, F.lit(")")), F.concat(text, F.lit("e2")),
    ]
    chosen = F.get(F.array(*spellings), (F.col("o_orderkey") % 10).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", chosen.alias("text"))
