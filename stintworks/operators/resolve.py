"""Resolve batches of name requests against the canonical layer, one outcome per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stintworks.functions.cleaning import folded, trimmed
from stintworks.workspace import materialize

MAX_SIMILAR = 50
SUGGESTIONS = 10
# Lengths of the text pieces names are looked up by; a text uses the longest that fits in it.
GRAMS = (1, 2, 3, 6, 12, 24)

# Outcomes and the status codes a request interface gives them.
OK, NOT_FOUND, CLUB_MISMATCH, AMBIGUOUS = "OK", "NOT_FOUND", "CLUB_MISMATCH", "AMBIGUOUS"
NOT_ELIGIBLE, INVALID = "NOT_ELIGIBLE", "INVALID"
COHORT_TOO_SMALL, MISSING_FEATURES = "COHORT_TOO_SMALL", "MISSING_FEATURES"
STATUS_CODES = {OK: 200, NOT_FOUND: 404, CLUB_MISMATCH: 400, AMBIGUOUS: 400, NOT_ELIGIBLE: 422,
                INVALID: 422, COHORT_TOO_SMALL: 500, MISSING_FEATURES: 500}

_MATCHED = ["canonical_player_key", "season", "player_name", "position_raw", "position_group", "minutes",
            "is_similarity_eligible"]
_ANY_SEASON = -1
LOOKUP = ["lookup_name", "lookup_club", "lookup_season"]


def with_lookup(requests: DataFrame) -> DataFrame:
    """Add the folded name and club and the season the request is limited to."""
    club = F.when(F.col("club") != "", folded(trimmed(F.col("club"))))
    return requests.withColumns(
        {
            "lookup_name": folded(trimmed(F.col("name"))),
            "lookup_club": club,
            "lookup_season": F.coalesce("season", F.lit(_ANY_SEASON)),
        }
    )


def _candidates(canonical: DataFrame) -> DataFrame:
    return canonical.withColumns(
        {"lookup_name": folded(F.col("player_name")), "lookup_club": folded(F.col("primary_squad_name"))}
    )


def _scopes(asked: DataFrame) -> list[list[str]]:
    """Grouping columns for the kinds of requests there are: with or without season and club."""
    club, season = F.col("lookup_club").isNotNull(), F.col("season").isNotNull()
    kinds = asked.agg(
        F.bool_or(~season).alias("any"), F.bool_or(season).alias("season"),
        F.bool_or(club & ~season).alias("club"), F.bool_or(club & season).alias("both"),
    ).first()
    scopes = {"any": [], "season": ["lookup_season"], "club": ["lookup_club"], "both": ["lookup_club", "lookup_season"]}
    return [["lookup_name", *columns] for kind, columns in scopes.items() if kinds[kind]] or [["lookup_name"]]


def _match_counts(people: DataFrame, scopes: list[list[str]]) -> DataFrame:
    """Matches per name within each scope.

    Counting first means a request meets one row per scope, however many rows share its name.
    """
    one = F.struct(*[F.col(c).alias(f"matched_{c}") for c in _MATCHED])
    people = people.withColumn("lookup_season", F.col("season"))
    columns = ["lookup_name", "lookup_club", "lookup_season"]
    sets = [[F.col(c) for c in scope] for scope in scopes]
    return people.groupingSets(sets, *columns).agg(
        (F.grouping("lookup_club") == 0).alias("by_club"),
        F.when(F.grouping("lookup_season") == 1, _ANY_SEASON)
        .otherwise(F.max("season"))
        .alias("scope_season"),
        F.count(F.lit(1)).alias("matches"),
        F.min(one).alias("match"),
    )


def resolve(requests: DataFrame, canonical: DataFrame, suggest: bool = False) -> DataFrame:
    """Requests plus ``status``, ``status_code``, ``detail``, the lookup and the single match's columns.

    ``requests`` has request_id, name, club, season and k; a NULL season searches all seasons.
    Pass only the eligible rows to resolve within the similarity population. ``suggest`` adds up to
    ten possible matches to the text of names that were not found. ``lookup_name``, ``lookup_club`` and
    ``lookup_season`` lead to the rows of ``ambiguous_candidates``.
    """
    # Names are folded once; the kinds of requests, the wanted names and the joins read the stored lookups.
    asked = materialize(with_lookup(requests), "asked")
    people = _candidates(canonical)
    wanted = asked.select("lookup_name").distinct()
    counts = _match_counts(people.join(wanted, "lookup_name", "left_semi"), _scopes(asked))
    by_name = counts.filter(~F.col("by_club")).select(
        F.col("lookup_name"), F.col("scope_season").alias("lookup_season"),
        F.col("matches").alias("name_matches"), F.col("match").alias("name_match"),
    )
    by_club = counts.filter(F.col("by_club") & F.col("lookup_club").isNotNull()).select(
        F.col("lookup_name"), F.col("lookup_club"), F.col("scope_season").alias("lookup_season"),
        F.col("matches").alias("club_matches"), F.col("match").alias("club_match"),
    )
    # Only requests with a club meet the counts by club; all meet those by name, once.
    clubs = asked.filter("lookup_club IS NOT NULL").join(by_club, ["lookup_name", "lookup_club", "lookup_season"], "left")
    asked = clubs.unionByName(asked.filter("lookup_club IS NULL"), allowMissingColumns=True)
    joined = asked.join(by_name, ["lookup_name", "lookup_season"], "left")
    has_club = F.col("lookup_club").isNotNull()
    matches = F.when(has_club, F.col("club_matches")).otherwise(F.col("name_matches"))
    match = F.when(has_club, F.col("club_match")).otherwise(F.col("name_match"))
    in_range = F.col("name").isNotNull()
    if "k" in requests.columns:
        in_range &= F.coalesce(F.col("k").between(1, MAX_SIMILAR), F.lit(True))
    status = (
        F.when(~in_range, INVALID)
        .when(F.col("name_matches").isNull(), NOT_FOUND)
        .when(matches.isNull(), CLUB_MISMATCH)
        .when(matches > 1, AMBIGUOUS)
        .otherwise(OK)
    )
    outcome = joined.withColumns({"matches": F.coalesce(matches, F.lit(0)), "match": match, "status": status})
    single = F.when(F.col("status") == OK, F.col("match"))
    resolved = outcome.select(
        *requests.columns,
        "status",
        "matches",
        *[single.getField(f"matched_{c}").alias(f"matched_{c}") for c in _MATCHED],
        *LOOKUP[:2],
        F.nullif("lookup_season", F.lit(_ANY_SEASON)).alias("lookup_season"),
    )
    resolved = with_detail(resolved)
    # Suggestions read the outcomes twice.
    return with_suggestions(materialize(resolved, "resolved"), canonical) if suggest else resolved


def with_detail(resolved: DataFrame) -> DataFrame:
    """Fill ``detail`` and ``status_code`` from ``status``."""
    name, club = F.col("name"), F.col("club")
    # Phrases callers match on.
    texts = {
        INVALID: F.format_string("The limit must be between 1 and %d and the name must be given.", F.lit(MAX_SIMILAR)),
        NOT_FOUND: F.format_string('Player "%s" was not found.', name),
        CLUB_MISMATCH: F.format_string('Player "%s" was found, but not with primary club "%s".', name, club),
        AMBIGUOUS: F.format_string(
            'Multiple canonical players match "%s" (%d). Specify the club parameter.', name, F.col("matches")
        ),
        NOT_ELIGIBLE: F.format_string(
            'Player "%s" exists, but is not eligible for similarity analysis. Position: %s. '
            "Current minutes: %d. Minimum required: 900.",
            F.col("matched_player_name"), F.col("matched_position_raw"), F.col("matched_minutes"),
        ),
        COHORT_TOO_SMALL: F.format_string("Not enough eligible players in cohort %s.", F.col("matched_position_group")),
        MISSING_FEATURES: F.format_string("Missing feature values in cohort %s.", F.col("matched_position_group")),
    }
    return resolved.withColumns({"status_code": _case(STATUS_CODES), "detail": _case(texts)})


def _case(values: dict[str, object]) -> Column:
    options = [F.when(F.col("status") == s, v if isinstance(v, Column) else F.lit(v)) for s, v in values.items()]
    return F.coalesce(*options)


def flag_not_eligible(resolved: DataFrame) -> DataFrame:
    barred = (F.col("status") == OK) & ~F.col("matched_is_similarity_eligible")
    return with_detail(resolved.withColumn("status", F.when(barred, NOT_ELIGIBLE).otherwise(F.col("status"))))


def ambiguous_candidates(resolved: DataFrame, canonical: DataFrame) -> DataFrame:
    """Every candidate of every ambiguous lookup, one row each.

    Rows are per distinct lookup, not per request, so repeated requests for a crowded name do not
    multiply its matches.
    """
    asked = with_lookup(resolved.filter(F.col("status") == AMBIGUOUS))
    lookups = materialize(asked.select(*LOOKUP).distinct(), "ambiguous")
    people = _candidates(canonical)
    line = F.concat_ws(
        " — ", "player_name", "primary_squad_name", "primary_competition_name",
        F.coalesce("position_raw", F.lit("None")), F.concat(F.col("minutes"), F.lit(" min")),
    )
    people = people.select("lookup_name", "lookup_club", F.col("season").alias("lookup_season"), "canonical_player_key", "season", line.alias("candidate"))
    found = None
    for scope in _scopes(lookups.withColumn("season", F.nullif("lookup_season", F.lit(_ANY_SEASON)))):
        # Each kind of lookup joins on all that it names, so namesakes elsewhere never meet it.
        club, season = F.col("lookup_club").isNotNull(), F.col("lookup_season") != _ANY_SEASON
        kind = (club if "lookup_club" in scope else ~club) & (season if "lookup_season" in scope else ~season)
        other = [c for c in LOOKUP if c not in scope]
        rows = lookups.filter(kind).join(people.drop(*other), scope).select(*LOOKUP, "canonical_player_key", "season", "candidate")
        found = rows if found is None else found.unionByName(rows)
    return found.withColumn("lookup_season", F.nullif("lookup_season", F.lit(_ANY_SEASON)))


def with_candidates(resolved: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every candidate row of every ambiguous request: ``request_id, canonical_player_key, season, candidate``."""
    asked = resolved.filter(F.col("status") == AMBIGUOUS).select("request_id", *[F.col(c).alias(f"asked_{c}") for c in LOOKUP])
    same = [F.col(f"asked_{c}").eqNullSafe(F.col(c)) for c in LOOKUP]
    return asked.join(candidates, same).select("request_id", "canonical_player_key", "season", "candidate")


def _grams(text: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def substring_matches(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (text, name) where the name contains the text, both unique string columns.

    Each text looks up only its rarest gram of the longest length it has, so the join is on equal
    grams, nearly every joined pair is a true match, and a common gram is used only by a text that
    has nothing else. The empty text is its own gram.
    """
    pieces = F.array(F.lit(""))
    for size in GRAMS:
        pieces = F.when(F.length("text") >= size, _grams(F.col("text"), size)).otherwise(pieces)
    asked = materialize(texts.withColumn("gram", F.explode(pieces)), "grams")
    offers = [_grams(F.col("name"), size) for size in GRAMS]
    all_offers = F.array_distinct(F.concat(F.array(F.lit("")), *offers))
    offered = names.withColumn("gram", F.explode(all_offers))
    offered = materialize(offered.join(asked.select("gram").distinct(), "gram", "left_semi"), "offered")
    frequency = offered.groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    rarest = (
        asked.join(frequency, "gram", "left")
        .groupBy("text")
        .agg(F.min_by("gram", F.struct(F.coalesce("names", F.lit(0)), "gram")).alias("gram"))
    )
    return offered.join(rarest, "gram").filter(F.contains("name", "text")).select("text", "name")


def suggestions(resolved: DataFrame, canonical: DataFrame) -> DataFrame:
    """Up to ten (name, club, competition) per request that was not found, by name and key."""
    asked = with_lookup(resolved.filter(F.col("status") == NOT_FOUND))
    asked = materialize(asked.select("request_id", F.col("lookup_name").alias("text"), "lookup_season"), "unmatched")
    lookups = asked.select("text", "lookup_season").distinct()
    shown = ["player_name", "primary_squad_name", "primary_competition_name"]
    people = (
        _candidates(canonical)
        .groupBy("lookup_name", "season", *shown)
        .agg(F.min("canonical_player_key").alias("first_key"))
    )
    people = materialize(people, "people")
    names = people.select(F.col("lookup_name").alias("name")).distinct()
    pairs = substring_matches(lookups.select("text").distinct(), names)
    scoped = people.select("lookup_name", "player_name", F.col("season").alias("lookup_season")).distinct()
    scoped = scoped.unionByName(people.select("lookup_name", "player_name", F.lit(_ANY_SEASON).alias("lookup_season")).distinct())
    # The first ten names hold the first ten rows, so crowded texts shrink before they meet the people.
    by_name = Window.partitionBy("text", "lookup_season").orderBy("player_name", "lookup_name")
    first = (
        pairs.join(scoped, F.col("name") == F.col("lookup_name"))
        .join(lookups, ["text", "lookup_season"], "left_semi")
        .withColumn("place", F.dense_rank().over(by_name))
        .filter(F.col("place") <= SUGGESTIONS)
        .select("text", "lookup_season", F.col("player_name").alias("first_name"))
        .distinct()
    )
    in_season = (F.col("lookup_season") == _ANY_SEASON) | (F.col("lookup_season") == F.col("season"))
    hits = (
        materialize(first, "first-names")
        .join(people, F.col("first_name") == F.col("player_name"))
        .filter(in_season)
        .groupBy("text", "lookup_season", *shown)
        .agg(F.min("first_key").alias("first_key"))
    )
    by_row = Window.partitionBy("text", "lookup_season").orderBy("player_name", "first_key", "primary_squad_name", "primary_competition_name")
    top = hits.withColumn("position", F.row_number().over(by_row)).filter(F.col("position") <= SUGGESTIONS)
    return asked.join(top, ["text", "lookup_season"]).select("request_id", "position", *shown)


def with_suggestions(resolved: DataFrame, canonical: DataFrame) -> DataFrame:
    """The outcomes with up to ten possible matches in the text of names that were not found."""
    shown = F.format_string("%s (%s, %s)", "player_name", "primary_squad_name", "primary_competition_name")
    offered = suggestions(resolved, canonical).groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("position", shown.alias("text")))).alias("offered")
    )
    text = F.format_string('Player "%s" was not found exactly. Possible matches: %s', F.col("name"), F.array_join(F.col("offered.text"), "; "))
    joined = resolved.join(offered, "request_id", "left")
    detail = F.when(F.col("offered").isNotNull(), text).otherwise(F.col("detail"))
    return joined.withColumn("detail", detail).select(*resolved.columns)
