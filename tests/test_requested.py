import pytest
from pyspark.sql import functions as F

from stintworks import workspace
from stintworks.operators import requested
from stintworks.operators.resolve import SUGGESTIONS, ambiguous_candidates, resolve, suggestions, with_candidates
from stintworks.operators.similarity import build_space, neighbours, similar
from stintworks.schemas import FEATURES
from stintworks.workspace import materialize


@pytest.fixture(scope="module")
def people(spark):
    """Twenty forwards and four keepers-out; values differ but for two flat profiles."""
    rows = []
    for i in range(24):
        group = "FW" if i < 20 else "DF_FW"
        values = [round((i * (j + 3) % 17) / 7, 4) for j in range(len(FEATURES))]
        rows.append((f"k{i:02d}", 2025, f"Name {i:02d}" if i else "Same Name", "S" if i % 2 else "T", "L", "FW", group, 1000, 1, True, *values))
    rows.append(("k99", 2025, "Same Name", "U", "L", "FW", "FW", 1000, 1, True, *[1.0] * len(FEATURES)))
    fields = ", ".join(f"{f} decimal(20,4)" for f in FEATURES)
    from decimal import Decimal

    cells = [tuple(Decimal(str(v)) if isinstance(v, float) else v for v in r) for r in rows]
    return spark.createDataFrame(
        cells,
        "canonical_player_key string, season int, player_name string, primary_squad_name string, primary_competition_name string, position_raw string, "
        "position_group string, minutes long, stint_count long, is_similarity_eligible boolean, " + fields,
    ).cache()


@pytest.fixture(scope="module")
def space(people):
    return build_space(people)


def ask(spark, *rows):
    filled = [(i, *row, None, None, None)[:6] for i, row in enumerate(rows)]
    return spark.createDataFrame(
        [(i, name, club, None, rank, candidate) for i, name, club, rank, candidate, _ in filled],
        "request_id long, name string, club string, season int, rank int, candidate string",
    )


def status(outcomes):
    return {r.request_id: (r.status, r.status_code) for r in outcomes.collect()}


def test_every_request_has_an_outcome(spark, people, space):
    requests = ask(spark, ("name 01", None, 1, "Name 02"), ("nobody", None, 1, "x"), ("Same Name", None, 1, "x"), ("Same Name", "U", 1, "x"), ("Name 21", None, 1, "Name 22"))
    outcomes, rows = requested.compare(requests, people, space, k=2)
    assert status(outcomes) == {0: ("OK", 200), 1: ("NOT_FOUND", 404), 2: ("AMBIGUOUS", 400), 3: ("OK", 200), 4: ("OK", 200)}
    assert {(r.request_id, r.metric): r.n for r in rows.groupBy("request_id", "metric").agg(F.count(F.lit(1)).alias("n")).collect()} == {
        (i, m): 2 for i in (0, 3, 4) for m in ("euclidean", "manhattan", "cosine")
    }


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_explain_by_rank(spark, people, space, metric):
    requests = ask(spark, ("Name 01", None, 1), ("Name 01", None, 20), ("Name 01", None, 21), ("Name 21", None, 4), ("nobody", None, 1))
    outcomes, rows = requested.explain(requests, people, space, metric)
    told = status(outcomes)
    assert told[2] == ("RANK_UNAVAILABLE", 400) and told[3] == ("RANK_UNAVAILABLE", 400) and told[4] == ("NOT_FOUND", 404)
    assert told[0] == told[1] == ("OK", 200)
    assert outcomes.filter("request_id = 2").first().detail == "Only 20 similar players were available."
    assert {(r.request_id, r["rank"]) for r in rows.collect()} == {(0, 1), (1, 20)} and rows.count() == 2 * len(FEATURES)
    with pytest.raises(ValueError):
        requested.explain(ask(spark, ("Name 01", None, 0)), people, space, metric)


def test_a_rank_beyond_the_cohort_is_not_searched_for(spark, people, space, monkeypatch):
    """How many rows there are needs no list of them: only ranks that exist reach the search."""
    searched = []

    def search(space, targets, metric):
        searched.extend((r.target_id, r.k, sorted(r.ranks)) for r in targets.collect())
        return neighbours(space, targets, metric)

    monkeypatch.setattr(requested, "neighbours", search)
    outcomes, rows = requested.explain(ask(spark, ("Name 01", None, 3), ("Name 01", None, 1_000_000), ("Name 02", None, 1_000_000)), people, space)
    assert searched == [("k01|2025", 3, [3])]
    assert status(outcomes) == {0: ("OK", 200), 1: ("RANK_UNAVAILABLE", 400), 2: ("RANK_UNAVAILABLE", 400)}
    assert {r.detail for r in outcomes.filter("request_id > 0").collect()} == {"Only 20 similar players were available."}
    assert rows.count() == len(FEATURES)


def test_a_zero_vector_has_no_cosine_explanation(spark, people):
    flat = people.filter("canonical_player_key IN ('k01', 'k02', 'k03')")
    for f in FEATURES:
        flat = flat.withColumn(f, F.lit(1).cast("decimal(20,4)"))
    outcomes, rows = requested.explain(ask(spark, ("Name 01", None, 1)), flat, build_space(flat), "cosine")
    assert status(outcomes) == {0: ("ZERO_VECTOR", 400)} and rows.isEmpty()


def test_role_and_diagnosis(spark, people, space):
    requests = ask(spark, ("Name 01", None, 1, " NAME 02"), ("Name 21", None, 1, "Name 02"), ("Name 01", None, 1, "nobody"))
    outcomes, rows = requested.role(requests, people, space, n=5)
    assert status(outcomes) == {0: ("OK", 200), 1: ("NO_ROLE_FEATURES", 400), 2: ("OK", 200)}
    assert all(0 <= r.overlap <= 5 for r in rows.collect()) and rows.count() == 2
    outcomes, rows = requested.diagnose(requests, people, space)
    assert status(outcomes) == {0: ("OK", 200), 1: ("CANDIDATE_NOT_FOUND", 404), 2: ("CANDIDATE_NOT_FOUND", 404)}
    (row,) = rows.collect()
    assert row.other_key == "k02" and 1 <= row.euclidean_rank <= 20


def test_outcome_texts_carry_what_the_caller_needs(spark, people):
    outcomes = resolve(ask(spark, ("name 0", None), ("qq", None), ("Same Name", None)).drop("rank", "candidate"), people, suggest=True)
    rows = {r.request_id: r for r in outcomes.collect()}
    assert rows[0].detail.startswith('Player "name 0" was not found exactly. Possible matches: Name 01 (S, L); Name 02 (T, L)')
    assert rows[0].detail.count(";") == 8 and rows[1].detail == 'Player "qq" was not found.'
    reached = with_candidates(outcomes, ambiguous_candidates(outcomes, people)).collect()
    assert {r.canonical_player_key for r in reached} == {"k00", "k99"} and {r.request_id for r in reached} == {2}


@pytest.mark.parametrize("k", [0, 51, 500])
def test_the_limit_has_a_range(spark, people, k):
    with pytest.raises(ValueError):
        similar(ask(spark, ("Name 01", None)).drop("rank", "candidate"), people, k=k)


def test_a_crowded_text_shrinks_to_ten_names_before_it_meets_people(spark, people):
    """One letter that all of many names hold: the join with people sees ten names, the plan limits early."""
    crowd = spark.range(20_000).select(
        F.format_string("n%05d", "id").alias("canonical_player_key"), F.lit(2025).alias("season"), F.format_string("An %05d", "id").alias("player_name"),
        F.lit("S").alias("primary_squad_name"), F.lit("L").alias("primary_competition_name"), F.lit("FW").alias("position_raw"),
        F.lit("FW").alias("position_group"), F.lit(1000).cast("long").alias("minutes"), F.lit(True).alias("is_similarity_eligible"),
    )
    outcomes = resolve(ask(spark, ("a", None), ("N 0001", None)).drop("rank", "candidate"), crowd)
    found = suggestions(outcomes, crowd)
    shown = {i: [r.player_name for r in found.filter(F.col("request_id") == i).orderBy("position").collect()] for i in (0, 1)}
    assert shown == {0: [f"An {i:05d}" for i in range(SUGGESTIONS)], 1: [f"An {i:05d}" for i in range(10, 20)]}
    assert "first-names" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_explanations_are_stored_and_joined_by_pair(spark, people, space, metric, monkeypatch):
    stored = {}
    monkeypatch.setattr(requested, "materialize", lambda df, name, *path: stored.setdefault(name, []).append(made := materialize(df, name, *path)) or made)
    asks = [("Name 01", None, 1), ("Name 01", None, 3), ("Name 01", "S", 3), ("Name 02", None, 1), ("nobody", None, 1)]
    outcomes, rows = requested.explain(ask(spark, *asks), people, space, metric)
    assert [t.count() for t in stored["explained"]] == [3]
    assert "feature" not in stored["explained"][0].columns
    assert [r.status for r in outcomes.orderBy("request_id").collect()] == ["OK"] * 4 + ["NOT_FOUND"]
    assert {r.request_id: r["count"] for r in rows.groupBy("request_id").count().collect()} == {i: len(FEATURES) for i in range(4)}


def test_an_explanation_leaves_only_what_it_returns(spark, people, space):
    left = []
    with pytest.MonkeyPatch.context() as patch, workspace.scope(spark):
        patch.setattr(requested, "new_path", lambda spark, name: left.append(workspace.new_path(spark, name)) or left[-1])
        outcomes, rows = requested.explain(ask(spark, ("Name 01", None, 3), ("Name 02", None, 1_000_000)), people, space)
        assert sorted(workspace._SCOPES[-1]) == sorted(left) and len(left) == 2
        assert [r.status for r in outcomes.orderBy("request_id").collect()] == ["OK", "RANK_UNAVAILABLE"]
        assert rows.count() == len(FEATURES)


def test_requests_without_a_club_do_not_meet_the_counts_by_club(spark, people):
    asks = ask(spark, ("Name 01", None, 1), ("Name 01", "S", 1), ("Name 01", "Z", 1), ("Same Name", None, 1), ("Same Name", "U", 1), ("nobody", "S", 1), (None, "S", 1))
    found = resolve(asks, people)
    assert [r.status for r in found.orderBy("request_id").collect()] == ["OK", "OK", "CLUB_MISMATCH", "AMBIGUOUS", "OK", "NOT_FOUND", "INVALID"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "isnull(lookup_club" in plan
