"""Registered queries: each operator on the driver's tables, and the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from stintworks.fixtures import adapter, oracle
from stintworks.fixtures.oracle import CANONICAL, RANKED, SPACE, STG, query
from stintworks.functions.cleaning import clean_decimal, clean_int, first_integer, first_token, rest_after_first_token
from stintworks.operators import cohorts, constraints, neighbours as search, requested, similarity
from stintworks.operators.canonical import canonical, canonical_by_source_key
from stintworks.operators.explore import explore
from stintworks.operators.identity import collision_report
from stintworks.operators.merge import last_per_key, merge_by_key
from stintworks.operators.records import PROFILE, profiles, rounded, similar_records
from stintworks.operators.resolve import LOOKUP, ambiguous_candidates, flag_not_eligible, resolve, suggestions, with_candidates
from stintworks.operators.views import intelligence_base, season_analysis
from stintworks.plans.api_landing import TEAM, land_api_documents, land_into_store as land_star, latest_documents, star_table
from stintworks.plans.running_layer import RunningLayer
from stintworks.plans.season_landing import BATCHES, land_into_store, land_season_csv, prepare_season_csv, stage_into_store
from stintworks.plans.store import TableStore
from stintworks.schemas import FEATURES, STAGING
from stintworks.sources.api_documents import read_api_containers, write_api_containers
from stintworks.sources.season_csv import file_hashes
from stintworks.workspace import materialize, new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: plain(build(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return build

    return add


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that both engines show the same types."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name)
            if f.dataType.typeName() == "decimal"
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


@register("canonical_source_key", oracle.query([oracle.STG, oracle.canon("stg", "source_player_key", "player_name")], "SELECT * FROM canon"))
def canonical_source_key(spark, sf_dir):
    return canonical_by_source_key(adapter.stints(spark, sf_dir))


@register("canonical_resolved", oracle.query(oracle.CANONICAL, "SELECT * FROM canon"))
def canonical_resolved(spark, sf_dir):
    return canonical(adapter.resolved(spark, sf_dir))


def _running_layer(spark, sf_dir) -> RunningLayer:
    """The stints in three batches, folded one after the other; the second one comes twice."""
    def at(path: str) -> RunningLayer:
        return RunningLayer(TableStore(spark, path), tie_break=("id",), buckets=8)

    def write() -> str:
        rows = adapter.resolved(spark, sf_dir).withColumn("batch_id", F.col("id") % 3)
        path = new_path(spark, "running-layer")
        for batch in (0, 1, 1, 2):
            at(path).add(rows.filter(F.col("batch_id") == batch))
        return path

    return at(adapter.layer_path(spark, sf_dir, "running-layer", write))


@register("canonical_by_batches", oracle.query(oracle.CANONICAL, "SELECT * FROM canon"))
def canonical_by_batches(spark, sf_dir):
    return _running_layer(spark, sf_dir).canonical()


@register("moments_by_batches", query(SPACE, oracle.MOMENTS))
def moments_by_batches(spark, sf_dir):
    return rounded(cohorts.moments_long(_running_layer(spark, sf_dir).moments()), "mean", "std")


@register("identity_resolved", oracle.query(oracle.RESOLVED, "SELECT id, source_player_key, season, squad_name, competition_name, player_name, CAST(minutes AS BIGINT) AS minutes, canonical_player_key, canonical_player_name, identity_overridden FROM res"))
def identity_resolved(spark, sf_dir):
    return adapter.resolved(spark, sf_dir).select("id", "source_player_key", "season", "squad_name", "competition_name", "player_name", F.col("minutes").cast("long").alias("minutes"), "canonical_player_key", "canonical_player_name", "identity_overridden")


@register("override_build", oracle.query(oracle.RESOLVED, "SELECT * FROM ovr"))
def override_build(spark, sf_dir):
    return adapter.overrides(spark, sf_dir)


@register("collision_report", query([STG, oracle.GROUPED], oracle.COLLISIONS))
def collisions(spark, sf_dir):
    return collision_report(adapter.stints(spark, sf_dir))


@register("source_keys", query([STG], "SELECT k, player_name, born_year, nation_raw, sha256(player_name || '|' || born_year || '|' || nation_raw) AS source_player_key FROM ent"))
def source_keys(spark, sf_dir):
    return adapter.entities(spark, sf_dir).select("k", "player_name", "born_year", "nation_raw", "source_player_key")


@register("intelligence_base", query([STG, oracle.GROUPED], oracle.BASE))
def base(spark, sf_dir):
    return intelligence_base(adapter.stints(spark, sf_dir))


@register("season_analysis", query([STG], oracle.STAR))
def star_view(spark, sf_dir):
    return season_analysis(*adapter.star(spark, sf_dir))


def _explore(name: str, where: str, limit: int, offset: int, **filters):
    listed = ("SELECT canonical_player_key, player_name AS name, primary_squad_name AS club, "
              "primary_competition_name AS competition, position_raw AS position, position_group, "
              "CAST(trunc(age) AS INTEGER) AS age, minutes, goals, assists, stint_count, "
              "is_similarity_eligible AS similarity_eligible, sample_quality FROM canon")
    page_sql = f"{listed} WHERE {where} ORDER BY minutes DESC, player_name, canonical_player_key, season LIMIT {limit} OFFSET {offset}"

    @register(f"explore_{name}_page", query(CANONICAL, page_sql))
    def page(spark, sf_dir):
        return explore(adapter.canonical_layer(spark, sf_dir), limit=limit, offset=offset, **filters)[1]

    @register(f"explore_{name}_total", query(CANONICAL, f"SELECT count(*) AS total FROM canon WHERE {where}"))
    def total(spark, sf_dir):
        return explore(adapter.canonical_layer(spark, sf_dir), limit=limit, offset=offset, **filters)[0]


_explore("default", "TRUE", 25, 0)
_explore("search", "player_name ILIKE '%r#0000_0%'", 100, 20, search=" r#0000_0 ")
_explore("club", "lower(primary_squad_name) = 'nation_3' AND lower(primary_competition_name) = 'europe'", 50, 0, club="Nation_3 ", competition="EUROPE")
_explore("eligible", "position_group = 'FW' AND minutes >= 900 AND is_similarity_eligible", 20, 40, position_group="fw", min_minutes=900, similarity_eligible=True)
_explore("ineligible", "NOT is_similarity_eligible AND minutes >= 0", 25, 5, similarity_eligible=False, min_minutes=0)


_explore("deep", "minutes >= 0", 30, 400, min_minutes=0, range_rows=64)


@register("resolve_requests", oracle.RESOLVED_REQUESTS)
def resolve_requests(spark, sf_dir):
    found = resolve(adapter.requests(spark, sf_dir), adapter.canonical_layer(spark, sf_dir), suggest=True)
    return found.select("request_id", "status", "status_code", "detail", "matches", F.col("matched_canonical_player_key").alias("canonical_player_key"), F.col("matched_season").alias("season"), *LOOKUP)


@register("ambiguous_requests", oracle.AMBIGUOUS_REQUESTS)
def ambiguous_requests(spark, sf_dir):
    """Every candidate of every ambiguous request, reached through the lookup of its outcome."""
    people = adapter.canonical_layer(spark, sf_dir)
    outcomes = resolve(adapter.requests(spark, sf_dir), people)
    return with_candidates(outcomes, ambiguous_candidates(outcomes, people))


@register("resolve_eligible_only", query([*CANONICAL, oracle.REQ_WITH_K.replace("JOIN canon c ON", "JOIN (SELECT * FROM canon WHERE is_similarity_eligible AND position_group <> 'GK') c ON")], "SELECT request_id, resolved_status AS status, matches, canonical_player_key, season FROM matched"))
def resolve_eligible_only(spark, sf_dir):
    people = cohorts.similarity_population(adapter.canonical_layer(spark, sf_dir))
    found = resolve(adapter.requests(spark, sf_dir), people)
    return found.select("request_id", "status", "matches", F.col("matched_canonical_player_key").alias("canonical_player_key"), F.col("matched_season").alias("season"))


@register("suggestions", query([*CANONICAL, oracle.REQ_WITH_K], oracle.SUGGESTED))
def suggested(spark, sf_dir):
    people = adapter.canonical_layer(spark, sf_dir)
    return suggestions(resolve(adapter.requests(spark, sf_dir), people), people)


@register("ambiguous_candidates", query([*CANONICAL, oracle.REQ_WITH_K], oracle.CANDIDATES))
def candidates(spark, sf_dir):
    people = adapter.canonical_layer(spark, sf_dir)
    return ambiguous_candidates(resolve(adapter.requests(spark, sf_dir), people), people)


def _flat(df: DataFrame, sections) -> DataFrame:
    return df.select("request_id", "status", "detail", *[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s, fields in sections.items() for f in fields])


@register("profile", query([*CANONICAL, oracle.REQ_ANY], oracle.profile_sql(PROFILE)))
def profile(spark, sf_dir):
    people = adapter.canonical_layer(spark, sf_dir)
    return _flat(profiles(resolve(adapter.requests(spark, sf_dir).drop("k"), people), people), PROFILE)


@register("cohort_moments", query(SPACE, oracle.MOMENTS))
def cohort_moments(spark, sf_dir):
    people = cohorts.similarity_population(adapter.canonical_layer(spark, sf_dir))
    return rounded(cohorts.moments_long(cohorts.moments(people)), "mean", "std")


@register("zscores", query(SPACE, "SELECT key, season, position_group, n AS cohort_size, " + ", ".join(f"round(z{i}, 6) + 0 AS z_{f}" for i, f in enumerate(FEATURES)) + " FROM z"))
def zscores(spark, sf_dir):
    rows = adapter.similarity_space(spark, sf_dir).rows
    z = [(F.round(F.col("z")[i], 6) + 0).alias(f"z_{f}") for i, f in enumerate(FEATURES)]
    return rows.select("key", "season", "position_group", "cohort_size", *z)


def _knn(metric: str, k: int):
    @register(f"knn_{metric}", oracle.knn(metric, k))
    def knn(spark, sf_dir):
        return rounded(similarity.neighbours(adapter.similarity_space(spark, sf_dir), metric=metric, k=k), "score")


for _metric in ("euclidean", "cosine", "manhattan"):
    _knn(_metric, 10)


# Rows of a chunk that make the cohorts of a small input span several leaves and chunks, as large cohorts do.
SMALL_CHUNK = 16


def _knn_cells(metric: str, k: int):
    @register(f"knn_cells_{metric}", oracle.knn(metric, k))
    def knn_cells(spark, sf_dir):
        space = adapter.similarity_space(spark, sf_dir)
        return rounded(similarity.neighbours(space, metric=metric, k=k, chunk_rows=SMALL_CHUNK, force_tree=True), "score")


for _metric in ("euclidean", "cosine", "manhattan"):
    _knn_cells(_metric, 5)


@register("rank_cells", query(RANKED, oracle.DIAGNOSTIC))
def rank_cells(spark, sf_dir):
    space = adapter.similarity_space(spark, sf_dir)
    targets = similarity.all_targets(space, min_cohort=1)
    named = similarity.find_candidates(adapter.named_candidates(targets, space), space)
    return rounded(similarity.candidate_ranks(named, space, chunk_rows=SMALL_CHUNK, force_tree=True), "euclidean", "manhattan", "cosine")


@register("knn_pooled_cohort", oracle.POOLED)
def knn_pooled_cohort(spark, sf_dir):
    space = adapter.similarity_space(spark, sf_dir, ("position_group",))
    return rounded(similarity.neighbours(space, k=5), "score")


@register("similar_outcomes", query([*SPACE, oracle.REQ_WITH_K, oracle.SIMILAR], f"SELECT request_id, status, CAST({oracle.CODE} AS INTEGER) AS status_code, {oracle.DETAIL} AS detail FROM sized"))
def similar_outcomes(spark, sf_dir):
    space = adapter.similarity_space(spark, sf_dir)
    outcomes, _ = similarity.similar(adapter.requests(spark, sf_dir), adapter.canonical_layer(spark, sf_dir), space=space)
    return outcomes.select("request_id", "status", "status_code", "detail")


@register("similar_requests", query([*RANKED, oracle.REQ_WITH_K, oracle.SIMILAR], oracle.SIMILAR_ROWS))
def similar_requests(spark, sf_dir):
    space = adapter.similarity_space(spark, sf_dir)
    outcomes, found = similarity.similar(adapter.requests(spark, sf_dir), adapter.canonical_layer(spark, sf_dir), space=space)
    records = similar_records(outcomes, found, space)
    return records.select("request_id", F.col("player.name").alias("player"), F.explode("similar_players").alias("s")).select(
        "request_id", "player", "s.rank", "s.canonical_player_key", "s.name", "s.club", "s.competition", "s.position",
        "s.position_group", "s.minutes", "s.stint_count", "s.distance")


@register("metric_ranks", query(RANKED, oracle.METRIC_TOP))
def metric_ranks(spark, sf_dir):
    return rounded(similarity.compare_metrics(adapter.similarity_space(spark, sf_dir), k=10), "euclidean", "manhattan", "cosine")


@register("candidate_diagnostic", query(RANKED, oracle.DIAGNOSTIC))
def candidate_diagnostic(spark, sf_dir):
    space = adapter.similarity_space(spark, sf_dir)
    targets = similarity.all_targets(space, min_cohort=1)
    named = similarity.find_candidates(adapter.named_candidates(targets, space), space)
    return rounded(similarity.candidate_ranks(named, space), "euclidean", "manhattan", "cosine")


@register("explain_euclidean", query(RANKED, oracle.EXPLAIN_EUCLIDEAN))
def explain_euclidean(spark, sf_dir):
    space = adapter.similarity_space(spark, sf_dir)
    pairs, _ = similarity.nth_neighbour(space, 1)
    rows = similarity.explain_euclidean(pairs, space)
    return rounded(rows, "target_z", "candidate_z", "absolute_gap", "squared_contribution", "distance_share_pct", "distance")


@register("explain_cosine", query(RANKED, oracle.EXPLAIN_COSINE))
def explain_cosine(spark, sf_dir):
    space = adapter.similarity_space(spark, sf_dir)
    pairs, _ = similarity.nth_neighbour(space, 2, "cosine")
    rows = similarity.explain_cosine(pairs, space)
    return rounded(rows, "target_z", "candidate_z", "z_gap", "cosine_contribution", "similarity")


@register("nth_neighbour_status", query(RANKED, oracle.NTH_STATUS))
def nth_neighbour_status(spark, sf_dir):
    return similarity.nth_neighbour(adapter.similarity_space(spark, sf_dir), 100)[1]


@register("top_features", query(RANKED, oracle.TOP_FEATURES))
def top_features(spark, sf_dir):
    space = adapter.similarity_space(spark, sf_dir)
    pairs, _ = similarity.nth_neighbour(space, 1)
    rows = rounded(similarity.explain_euclidean(pairs, space), "absolute_gap", "squared_contribution")
    largest = similarity.top_features(rows, "squared_contribution").select(F.lit("largest").alias("list"), "target_id", "key", "season", "position", "feature")
    closest = similarity.top_features(rows, "absolute_gap", ascending=True).select(F.lit("closest").alias("list"), "target_id", "key", "season", "position", "feature")
    pairs, _ = similarity.nth_neighbour(space, 1, "cosine")
    rows = rounded(similarity.explain_cosine(pairs, space), "cosine_contribution", "z_gap")
    aligned = similarity.top_features(rows, "cosine_contribution").select(F.lit("aligned").alias("list"), "target_id", "key", "season", "position", "feature")
    apart = similarity.top_features(rows, "z_gap").select(F.lit("differences").alias("list"), "target_id", "key", "season", "position", "feature")
    return largest.unionByName(closest).unionByName(aligned).unionByName(apart)


@register("cohort_outcomes", oracle.COHORT_OUTCOMES)
def cohort_outcomes(spark, sf_dir):
    """The population with one feature value in ninety-seven taken away."""
    people = adapter.canonical_layer(spark, sf_dir)
    holed = people.withColumn("shots_per90", F.when(F.col("minutes") % 97 != 0, F.col("shots_per90")))
    return similarity.cohort_outcomes(similarity.build_space(holed))


def _by_request(spark, sf_dir):
    asked = adapter.named_requests(spark, sf_dir)
    return asked, adapter.canonical_layer(spark, sf_dir), adapter.similarity_space(spark, sf_dir)


@register("compare_requests", oracle.COMPARE_REQUESTS)
def compare_requests(spark, sf_dir):
    rows = requested.compare(*_by_request(spark, sf_dir), k=3)[1]
    score = F.when(F.col("metric") == "euclidean", F.col("euclidean")).when(F.col("metric") == "manhattan", F.col("manhattan")).otherwise(F.col("cosine"))
    return rounded(rows.withColumn("score", score), "score").select("request_id", "metric", "rank", "key", "season", "score")


@register("explain_request_outcomes", oracle.EXPLAIN_OUTCOMES)
def explain_request_outcomes(spark, sf_dir):
    return requested.explain(*_by_request(spark, sf_dir))[0].select("request_id", "status", "status_code", "detail")


@register("explain_mixed_ranks", oracle.EXPLAIN_MIXED)
def explain_mixed_ranks(spark, sf_dir):
    """A few requests ask for the millionth neighbour, the others for one near by."""
    asked, people, space = _by_request(spark, sf_dir)
    mixed = asked.withColumn("rank", F.when(F.col("request_id") % 97 == 5, 1_000_000).otherwise(F.col("rank")))
    return requested.explain(mixed, people, space)[0].select("request_id", "status", "status_code", "detail")


@register("explain_requests", oracle.EXPLAIN_REQUESTS)
def explain_requests(spark, sf_dir):
    rows = rounded(requested.explain(*_by_request(spark, sf_dir))[1], "absolute_gap", "squared_contribution", "distance")
    return rows.select("request_id", "key", "season", "rank", "feature", "absolute_gap", "squared_contribution", "distance")


@register("explain_requests_cosine", oracle.EXPLAIN_REQUESTS_COSINE)
def explain_requests_cosine(spark, sf_dir):
    rows = rounded(requested.explain(*_by_request(spark, sf_dir), metric="cosine")[1], "z_gap", "cosine_contribution")
    return rows.select("request_id", "key", "season", "rank", "feature", "z_gap", "cosine_contribution")


@register("role_requests", oracle.ROLE_REQUESTS)
def role_requests(spark, sf_dir):
    outcomes, rows = requested.role(*_by_request(spark, sf_dir))
    return outcomes.select("request_id", "status").join(rows.select("request_id", "overlap"), "request_id", "left")


@register("diagnose_requests", oracle.DIAGNOSE_REQUESTS)
def diagnose_requests(spark, sf_dir):
    outcomes, rows = requested.diagnose(*_by_request(spark, sf_dir))
    shown = rounded(rows, "euclidean").select("request_id", "other_key", "other_season", "euclidean", "euclidean_rank", "manhattan_rank", "cosine_rank")
    return outcomes.select("request_id", "status").join(shown, "request_id", "left")


@register("knn_role", query([*SPACE, oracle.ROLE], "SELECT target_id, key, season, CAST(role_rank AS INTEGER) AS rank, round(d, 6) AS score FROM role_ranked WHERE role_rank <= 10"))
def knn_role(spark, sf_dir):
    return rounded(similarity.role_neighbours(adapter.similarity_space(spark, sf_dir), k=10), "score")


@register("role_overlap", query([*RANKED, oracle.ROLE], oracle.OVERLAP))
def role_overlap(spark, sf_dir):
    return similarity.role_experiment(adapter.similarity_space(spark, sf_dir), n=10)


@register("embedding_knn", oracle.EMBEDDING)
def embedding_knn(spark, sf_dir):
    rows = adapter.table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("cohort"), F.col("vec_id").alias("key"), F.lit(0).alias("season"),
        F.col("embedding").cast("array<double>").alias("vec"))
    index = search.build_index(rows, 64, "cosine", 6)
    targets = rows.select(F.col("key").alias("target_id"), "cohort", "key", "vec")
    return rounded(search.nearest(targets, index, 5), "score").select(F.col("target_id").alias("vec_id"), F.col("key").alias("neighbour"), "rank", "score")


@register("season_csv_landing", query([STG], oracle.LANDED))
def season_csv_landing(spark, sf_dir):
    rows = adapter.landed(spark, sf_dir).staging
    cells = F.size(F.json_object_keys("payload"))
    kept = F.get_json_object("payload", "$.Player") == F.col("player_name")
    return rows.select(*oracle.LANDED_COLUMNS, cells.alias("payload_cells"), kept.alias("payload_kept"))


@register("season_csv_row_numbers", oracle.LANDED_ROWS)
def season_csv_row_numbers(spark, sf_dir):
    """Numbers start at one in every file and have no gaps: their count and their largest agree."""
    rows = adapter.landed(spark, sf_dir).staging
    per_file = rows.groupBy("batch_id").agg(
        F.min("source_row_number").alias("first"), F.count_distinct("source_row_number").alias("numbers"),
        F.max("source_row_number").alias("last"), F.count(F.lit(1)).alias("rows"), F.sum((F.col("id") == F.col("source_row_number")).cast("long")).alias("ids"))
    return per_file.agg(F.max("first").alias("first_number"), F.sum("last").alias("rows"), F.sum("numbers").alias("numbers"), F.sum("ids").alias("ids"))


@register("season_csv_batches", oracle.LANDED_BATCHES)
def season_csv_batches(spark, sf_dir):
    """Every batch has the hash, name and count of a file that was written; a second load changes nothing."""
    staging_dir, batches_dir = new_path(spark, "reload-staging"), new_path(spark, "reload-batches")
    source = adapter.season_csv_source(spark, sf_dir)
    first = land_season_csv(spark, source, 2025, "2025/26", staging_dir, batches_dir, source_id=2)
    def digest(rows: DataFrame) -> DataFrame:
        cells = F.xxhash64(*[c for c in rows.columns if c != "imported_at"]).cast("decimal(38,0)")
        return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(cells).alias("h"))

    before = materialize(digest(first.staging), "before")
    again = land_season_csv(spark, source, 2025, "2025/26", staging_dir, batches_dir, source_id=2)
    # Hashed once more in small parts: a file's whole content would be one cell.
    files = file_hashes(spark, source).select(F.element_at(F.split("_file", "/"), -1).alias("source_filename"), F.col("file_sha256").alias("sha"))
    told = again.batches.join(again.staging.groupBy("batch_id").count(), "batch_id").join(files, "source_filename")
    facts = told.select(
        "row_count", (F.col("row_count") == F.col("count")).alias("counts_fit"), (F.col("file_sha256") == F.col("sha")).alias("names_fit"),
        (F.col("batch_id") == F.conv(F.substring("sha", 1, 15), 16, 10).cast("long")).alias("ids_fit"))
    checks = facts.agg(F.sum("row_count").alias("rows"), *[F.bool_and(c).cast("long").alias(c) for c in ("counts_fit", "names_fit", "ids_fit")])
    changed = before.exceptAll(digest(again.staging)).agg(F.lit("changed").alias("what"), F.count(F.lit(1)).alias("value"))
    return checks.unpivot([], ["rows", "counts_fit", "names_fit", "ids_fit"], "what", "value").unionByName(changed)


@register("season_csv_reconciliation", query([STG], "SELECT competition_name, count(*) AS rows FROM stg GROUP BY competition_name"))
def season_csv_reconciliation(spark, sf_dir):
    counts = adapter.landed(spark, sf_dir).reconciliation
    return counts.groupBy("competition_name").agg(F.sum("rows").alias("rows"))


@register("batch_counts", oracle.BATCH_COUNTS)
def batch_counts(spark, sf_dir):
    return adapter.stints(spark, sf_dir).groupBy("season", "competition_name").agg(F.count(F.lit(1)).alias("rows"))


def _stamped(rows: DataFrame) -> DataFrame:
    """Times without zone and small integers as plain ones, as the other engine has them."""
    kinds = {"timestamp": "timestamp_ntz", "short": "int"}
    return rows.select(*[F.col(f.name).cast(kinds.get(f.dataType.typeName(), f.dataType)).alias(f.name) for f in rows.schema.fields])


@register("api_stats", oracle.API_STATS)
def api_stats(spark, sf_dir):
    """Measures the landing itself; the other queries of the documents share one landing."""
    return _stamped(land_api_documents(*adapter.api_documents(spark, sf_dir)).stats)


@register("api_players", oracle.API_PLAYERS)
def api_players(spark, sf_dir):
    return _stamped(adapter.api_landing(spark, sf_dir).player)


@register("api_competition", oracle.API_COMPETITION)
def api_competition(spark, sf_dir):
    return _stamped(adapter.api_landing(spark, sf_dir).competition)


@register("api_competition_season", oracle.API_COMPETITION_SEASON)
def api_competition_season(spark, sf_dir):
    return _stamped(adapter.api_landing(spark, sf_dir).competition_season).select("competition_id", "season", "is_current", "updated_at")


@register("api_team", oracle.API_TEAM)
def api_team(spark, sf_dir):
    return _stamped(adapter.api_landing(spark, sf_dir).team).select("api_football_id", "name", "code", "logo_url", "updated_at")


@register("api_files", oracle.API_FILES)
def api_files(spark, sf_dir):
    """Every document is written to a container, read back and compared: same name, same payload, same time."""
    documents, _ = adapter.api_documents(spark, sf_dir)
    folder = new_path(spark, "document-containers")
    write_api_containers(documents, folder)
    found = read_api_containers(spark, folder).select(F.col("document_id"), F.col("payload").alias("read"), F.col("fetched_at").alias("read_at"))
    both = documents.withColumn("known", F.lit(1)).join(found.withColumn("found", F.lit(1)), "document_id", "full")
    same = F.col("read").eqNullSafe(F.col("payload")) & F.col("read_at").eqNullSafe(F.col("fetched_at")) & F.col("known").isNotNull() & F.col("found").isNotNull()
    counts = both.agg(
        F.count("found").alias("documents"), F.count(F.when(same, 1)).alias("payloads"), F.count(F.when(~same, 1)).alias("lost")
    )
    return counts.unpivot([], ["documents", "payloads", "lost"], "what", "value")


@register("star_merge_twice", oracle.API_STATS)
def star_merge_twice(spark, sf_dir):
    """Documents of two periods merged one after the other into stored tables give the facts of one landing."""
    documents, requests = adapter.api_documents(spark, sf_dir)
    store = TableStore(spark, new_path(spark, "star-store"))
    late = F.year("fetched_at") >= 1995
    for period in (documents.filter(~late), documents.filter(late)):
        land_star(store, period, requests.join(period.select("document_id"), "document_id", "left_semi"))
    return _stamped(star_table(store, "stats"))


@register("star_parts_kept", oracle.STAR_PARTS)
def star_parts_kept(spark, sf_dir):
    """A merge of one team rewrites one part of the stored teams; the other parts keep their folders, and all rows are there."""
    documents, requests = adapter.api_documents(spark, sf_dir)
    store = TableStore(spark, new_path(spark, "star-store"))
    land_star(store, documents, requests)
    before = store.manifest()["team"]
    one = star_table(store, "team").orderBy("api_football_id").limit(1).withColumn("name", F.lit("renamed"))
    store.publish(store.stage_merge("team", TEAM, materialize(one, "one-team"), ["api_football_id"], ["name"]), store.version())
    after = store.manifest()["team"]
    changed = sum(after[p] != before.get(p) for p in after)
    teams = star_table(store, "team")
    counts = teams.agg(F.count(F.lit(1)).alias("teams"), F.count(F.when(F.col("name") == "renamed", 1)).alias("renamed"), F.lit(changed).cast("long").alias("parts_changed"))
    return counts.unpivot([], ["teams", "renamed", "parts_changed"], "what", "value")


@register("load_interrupted", oracle.LOAD_INTERRUPTED)
def load_interrupted(spark, sf_dir):
    """A load that ends before it publishes leaves rows and registry as they were; a repeated one changes no count."""
    store = TableStore(spark, new_path(spark, "season-store"))
    states = []

    def state(step: str) -> None:
        rows = store.read("staging", STAGING).agg(F.count(F.lit(1)).alias("rows"))
        told = store.read("batches", BATCHES).agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("registered"))
        states.append(rows.crossJoin(told).select(F.lit(step).alias("step"), "rows", "registered"))  # one row each

    europe, others = (adapter.season_csv_part(spark, sf_dir, part) for part in ("europe", "others"))
    land_into_store(store, europe, 2025, "2025/26", source_id=2)
    state("first")
    stage_into_store(store, prepare_season_csv(spark, others, 2025, "2025/26", source_id=2))  # and never published
    state("interrupted")
    land_into_store(store, others, 2025, "2025/26", source_id=2)
    state("second")
    land_into_store(store, europe, 2025, "2025/26", source_id=2)
    state("again")
    return reduce(DataFrame.unionByName, states)


@register("csv_malformed", oracle.CSV_MALFORMED)
def csv_malformed(spark, sf_dir):
    """Records with too many or too few cells come back with their text; the others land and are counted."""
    store = TableStore(spark, new_path(spark, "ragged-store"))
    landing = land_into_store(store, adapter.ragged_season_csv(spark, sf_dir), 2025, "2025/26", source_id=2, keep_malformed=True)
    bad = landing.malformed.agg(
        F.count(F.lit(1)).alias("malformed"), F.count(F.when(F.endswith("record", F.lit(",extra")), 1)).alias("longer"),
        F.count(F.when(F.col("record_number") < 1, 1)).alias("misplaced"))
    rows = landing.staging.agg(F.count(F.lit(1)).alias("landed"), F.count_distinct("batch_id", "source_row_number").alias("numbers"))
    told = landing.batches.agg(F.sum("row_count").alias("registered"))
    names = ["landed", "numbers", "registered", "malformed", "longer", "misplaced"]
    return rows.crossJoin(told).crossJoin(bad).unpivot([], names, "what", "value")  # one row each


@register("api_rejects", oracle.API_REJECTS)
def api_rejects(spark, sf_dir):
    return adapter.api_landing(spark, sf_dir).rejects


@register("api_unmatched", oracle.API_UNMATCHED)
def api_unmatched(spark, sf_dir):
    """Some documents without a request, some requests without a document."""
    documents, requests = adapter.api_documents(spark, sf_dir)
    order = F.col("document_id").cast("long")
    landing = land_api_documents(documents.filter(order % 7 != 3), requests.filter(order % 11 != 5))
    return landing.rejects.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("documents"), F.sum(order).alias("keys"))


@register("api_bad_cells", oracle.API_BAD_CELLS)
def api_bad_cells(spark, sf_dir):
    """Minutes as fractions round, as text they reject the document; a team without key does, too."""
    documents, requests = adapter.api_documents(spark, sf_dir)
    order = F.col("document_id").cast("long")
    payload = (
        F.when(order % 9 == 2, F.regexp_replace("payload", r'"minutes":(\d+)', r'"minutes":$1.5'))
        .when(order % 9 == 3, F.regexp_replace("payload", r'"minutes":(\d+)', r'"minutes":"$1 min"'))
        .when(order % 9 == 4, F.regexp_replace("payload", r'"team":\{"id":\d+', r'"team":{"id":null'))
        .otherwise(F.col("payload"))
    )
    landing = land_api_documents(documents.withColumn("payload", payload), requests)
    told = landing.summary.select(F.lit("LOADED").alias("outcome"), F.col("minutes").cast("long").alias("minutes"))
    told = told.unionByName(landing.rejects.select(F.col("reject_reason").alias("outcome"), F.lit(0).cast("long").alias("minutes")))
    return told.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"), F.sum("minutes").alias("minutes"))


@register("api_summary", oracle.API_SUMMARY)
def api_summary(spark, sf_dir):
    return adapter.api_landing(spark, sf_dir).summary


@register("api_latest_documents", oracle.API_LATEST)
def api_latest_documents(spark, sf_dir):
    raw = adapter.api_landing(spark, sf_dir).raw
    latest = latest_documents(raw).select("entity_api_id", "season", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"),
                                          F.contains("payload", F.concat(F.lit('"player":{"id":'), F.col("entity_api_id").cast("string"))).alias("payload_kept"))
    return latest


@register("clean_int", oracle.CLEAN_INT)
def clean_ints(spark, sf_dir):
    return adapter.untidy_numbers(spark, sf_dir).select("o_orderkey", clean_int(F.col("text")).alias("value"))


@register("clean_decimal", oracle.CLEAN_DECIMAL)
def clean_decimals(spark, sf_dir):
    return adapter.untidy_numbers(spark, sf_dir).select("o_orderkey", clean_decimal(F.col("text"), 8, 2).alias("value"))


@register("first_token", oracle.FIRST_TOKEN)
def first_tokens(spark, sf_dir):
    padded = F.concat(F.lit(" "), F.replace("o_orderpriority", F.lit(" "), F.lit("  ")))
    return adapter.table(spark, sf_dir, "orders").select("o_orderkey", first_token(padded).alias("code"), rest_after_first_token(padded).alias("rest"))


@register("first_integer", oracle.FIRST_INTEGER)
def first_integers(spark, sf_dir):
    sized = F.concat(F.lit("about "), F.col("p_size"), F.lit(" cm"))
    return adapter.table(spark, sf_dir, "part").select(
        "p_partkey", first_integer(F.col("p_brand")).alias("brand_number"), first_integer(F.col("p_name")).alias("name_number"), first_integer(sized).alias("size"))


def _merge(spark, sf_dir, mode):
    target = adapter.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("label"), F.col("c_acctbal").alias("amount"))
    updates = adapter.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") * 2).alias("key"), F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("amount"), "o_orderdate", "o_orderkey")
    return merge_by_key(target, updates, ["key"], ["label", "amount"], ["o_orderdate", "o_orderkey"], mode)


@register("merge_update", oracle.MERGE_UPDATE)
def merge_update(spark, sf_dir):
    return _merge(spark, sf_dir, "update")


@register("merge_ignore", oracle.MERGE_IGNORE)
def merge_ignore(spark, sf_dir):
    return _merge(spark, sf_dir, "ignore")


@register("merge_null_keys", oracle.MERGE_NULL_KEYS)
def merge_null_keys(spark, sf_dir):
    """Every seventh customer and every fifth order has no key: none of them matches, none is lost."""
    target = adapter.table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey")).alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"))
    updates = adapter.table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") * 2).alias("key"), F.col("o_totalprice").alias("amount"), "o_orderdate", "o_orderkey")
    merged = [
        merge_by_key(target, updates, ["key"], ["amount"], ["o_orderdate", "o_orderkey"], mode).withColumn("mode", F.lit(mode))
        for mode in ("update", "ignore")
    ]
    return merged[0].unionByName(merged[1])


@register("latest_document", oracle.LATEST)
def latest_document(spark, sf_dir):
    rows = adapter.table(spark, sf_dir, "events")
    return last_per_key(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value", "props")


@register("constraint_unique", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def constraint_unique(spark, sf_dir):
    return constraints.unique_violations(adapter.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("constraint_fk", "SELECT event_id, user_id FROM events WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def constraint_fk(spark, sf_dir):
    kept = adapter.table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'")
    child = adapter.table(spark, sf_dir, "events").select("event_id", "user_id")
    return constraints.foreign_key_violations(child, kept, {"user_id": "c_custkey"})


@register("constraint_not_null", query([STG], "SELECT id, position_raw, CAST(minutes AS INTEGER) AS minutes FROM stg WHERE position_raw IS NULL OR minutes IS NULL"))
def constraint_not_null(spark, sf_dir):
    rows = adapter.stints(spark, sf_dir).select("id", "position_raw", "minutes")
    return constraints.null_violations(rows, ["position_raw", "minutes"])


@register("constraint_length", "SELECT doc_id, n_chars FROM documents WHERE length(text) > 500 OR length(source) > 8")
def constraint_length(spark, sf_dir):
    return constraints.length_violations(adapter.table(spark, sf_dir, "documents"), {"text": 500, "source": 8}).select("doc_id", "n_chars")


@register("cascade_null_keys", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS o_custkey FROM orders WHERE o_orderkey % 5 = 0 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def cascade_null_keys(spark, sf_dir):
    kept = adapter.table(spark, sf_dir, "customer").filter("c_acctbal >= 0")
    child = adapter.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("o_custkey"))
    return constraints.cascade(child, kept, {"o_custkey": "c_custkey"})


@register("cascade_delete", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def cascade_delete(spark, sf_dir):
    kept = adapter.table(spark, sf_dir, "customer").filter("c_acctbal >= 0")
    return constraints.cascade(adapter.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), kept, {"o_custkey": "c_custkey"})
