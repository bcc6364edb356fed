from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stintworks.operators.canonical import canonical
from stintworks.operators.explore import explore
from stintworks.operators.records import profiles, similar_records
from stintworks.operators.resolve import ambiguous_candidates, resolve, suggestions
from stintworks.operators.similarity import build_space, similar
from stintworks.schemas import REQUESTS


@pytest.fixture(scope="module")
def layer(make_stints):
    def person(key, name, squad, minutes=1000, position="FW", season=2025, **more):
        return {"source_player_key": key, "player_name": name, "squad_name": squad, "minutes": minutes, "position_raw": position, "season": season, **more}

    rows = [
        person("v1", "Vitinha", "Genoa", 950, "FW"), person("v2", "Vitinha", "Paris", 2700, "MF"),
        person("k", "Kyle É", "Roma", 2599, shots=100, goals=25), person("f", "Kilian Fischer", "Wolfsburg", 800, "DF"),
        person("g", "Keeper", "Roma", 3000, "GK"), person("c", "a_c", "Roma"), person("d", "abc", "Roma"), person("z", "Zero", "Roma", 0),
        person("m1", "Mid One", "A", 1000, "MF", shots=3), person("s", "Old Timer", "A", 1000, "FW", 2024),
        person("s", "Old Timer", "B", 1000, "FW", 2025),
    ]
    return canonical(make_stints(*rows, identity=True)).cache()


def ask(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], REQUESTS)


def test_outcomes(spark, layer):
    requests = ask(
        spark, ("Vitinha", None, None, None), ("vitinha", " PARIS ", None, 5), ("Vitinha", "Lyon", None, None), ("Nobody", None, None, None),
        ("kilian", None, None, None), ("  kYLE é ", None, None, None), ("Vitinha", "", 2025, None), ("Old Timer", None, 2024, None),
        ("Old Timer", None, None, None), ("Keeper", None, None, 0), ("Keeper", None, None, 51), ("Keeper", None, 1999, 1), ("Kyle E", None, None, None))
    rows = resolve(requests, layer).orderBy("request_id").collect()
    assert [r.status for r in rows] == ["AMBIGUOUS", "OK", "CLUB_MISMATCH", "NOT_FOUND", "NOT_FOUND", "OK", "AMBIGUOUS", "OK", "AMBIGUOUS", "INVALID", "INVALID", "NOT_FOUND", "NOT_FOUND"]
    assert rows[1].matched_canonical_player_key == "v2" and rows[7].matched_season == 2024
    assert [r.status_code for r in rows][:5] == [400, 200, 400, 404, 404]
    assert "Multiple canonical players" in rows[0].detail and "Specify the club parameter" in rows[0].detail
    assert "was not found" in rows[3].detail and "not with primary club" in rows[2].detail and rows[1].detail is None


def test_candidates_name_both_clubs(spark, layer):
    resolved = resolve(ask(spark, ("Vitinha", None, None, None), ("VITINHA", None, None, None)), layer)
    lines = sorted(r.candidate for r in ambiguous_candidates(resolved, layer).collect())
    assert lines == ["Vitinha — Genoa — L — FW — 950 min", "Vitinha — Paris — L — MF — 2700 min"]


def test_suggestions(spark, layer):
    requests = ask(spark, ("kil", None, None, None), ("a", None, 2024, None), ("b", None, None, None), ("", None, None, None), ("xyz", None, None, None), ("timer", None, None, None))
    rows = suggestions(resolve(requests, layer), layer).orderBy("request_id", "position").collect()
    by_request = {}
    for r in rows:
        by_request.setdefault(r.request_id, []).append((r.player_name, r.primary_squad_name))
    everyone = sorted((r.player_name, r.canonical_player_key, r.primary_squad_name) for r in layer.select("player_name", "canonical_player_key", "primary_squad_name").distinct().collect())
    assert by_request == {0: [("Kilian Fischer", "Wolfsburg")], 2: [("abc", "Roma")], 3: [(n, c) for n, _, c in everyone][:10], 5: [("Old Timer", "A"), ("Old Timer", "B")]}


def test_profile_of_zero_minutes_is_null_safe(spark, layer):
    row = profiles(resolve(ask(spark, ("Zero", None, None, None)), layer), layer).first()
    assert row.status == "OK" and row.per90.shots is None and row.usage.minutes == 0 and row.data_quality.sample_quality == "LOW"


def test_profile_values(spark, layer):
    row = profiles(resolve(ask(spark, ("kyle é", None, None, None)), layer), layer).first()
    assert (row.identity.name, row.season.primary_club, row.usage.minutes, row.production.goals) == ("Kyle É", "Roma", 2599, 25)
    assert row.per90.shots == pytest.approx(3.4629) and row.data_quality.similarity_eligible and row.identity.age is None


def test_similar_outcomes_and_record(spark, layer):
    space = build_space(layer)
    requests = ask(spark, ("Kyle É", None, None, 3), ("Kilian Fischer", None, None, None), ("Keeper", None, None, None), ("Mid One", None, None, None),
                   ("Old Timer", None, 2024, None), ("Kyle É", None, None, None), ("Nobody", None, None, None))
    outcomes, found = similar(requests, layer, space=space)
    rows = {r.request_id: r for r in outcomes.collect()}
    assert [rows[i].status for i in range(7)] == ["OK", "NOT_ELIGIBLE", "NOT_ELIGIBLE", "COHORT_TOO_SMALL", "COHORT_TOO_SMALL", "OK", "NOT_FOUND"]
    assert "Current minutes: 800" in rows[1].detail and "Minimum required: 900" in rows[1].detail and "GK" in rows[2].detail
    records = {r.request_id: r for r in similar_records(outcomes, found, space).collect()}
    assert set(records) == {0, 5}
    assert [s["rank"] for s in records[0].similar_players] == [1, 2, 3] and len(records[5].similar_players) == 4
    distances = [s["distance"] for s in records[5].similar_players]
    assert distances == sorted(distances) and records[0].model.metric == "euclidean" and records[0].player.name == "Kyle É"


def test_eligible_only_does_not_find_the_ineligible(spark, layer):
    outcomes, _ = similar(ask(spark, ("Kilian Fischer", None, None, None)), layer, eligible_only=True)
    assert outcomes.first().status == "NOT_FOUND"


def test_explore(layer):
    total, page = explore(layer, limit=3, offset=1)
    assert total.first().total == 11
    assert [r.name for r in page.collect()] == ["Vitinha", "Kyle É", "Mid One"]

    def names(**filters):
        return sorted(r.name for r in explore(layer, limit=100, **filters)[1].collect())

    assert names(search="a_c") == ["a_c", "abc"] and names(search="a_c", literal_search=True) == ["a_c"]
    assert len(names(search="%")) == 11 and len(names(search="   ")) == 11 and len(names(search="")) == 11
    assert names(club=" paris ") == ["Vitinha"] and names(position_group="gk") == ["Keeper"] and names(competition="l ", min_minutes=2600) == ["Keeper", "Vitinha"]
    assert names(similarity_eligible=False) == ["Keeper", "Kilian Fischer", "Zero"] and len(names(min_minutes=0)) == 11


@pytest.mark.parametrize("bad", [{"limit": 0}, {"limit": 101}, {"offset": -1}, {"min_minutes": -1}])
def test_explore_validation(layer, bad):
    with pytest.raises(ValueError):
        explore(layer, **bad)


def test_age_is_cut_to_whole_years(make_stints):
    rows = canonical(make_stints({"age": Decimal("24.90"), "minutes": 1}, identity=True))
    assert explore(rows)[1].first().age == 24


def test_crowded_name_does_not_multiply(spark, make_stints):
    rows = canonical(make_stints(*[{"source_player_key": f"k{i}", "player_name": "Same", "minutes": i} for i in range(300)], identity=True))
    requests = ask(spark, *[("same", None, None, None)] * 200)
    resolved = resolve(requests, rows)
    assert resolved.filter((F.col("status") == "AMBIGUOUS") & (F.col("matches") == 300)).count() == 200
    assert ambiguous_candidates(resolved, rows).count() == 300


def test_deep_pages_equal_plain_ones(make_stints):
    rows = canonical(make_stints(*[{"source_player_key": f"k{i}", "player_name": f"N{i % 9}", "minutes": i % 4 * 100} for i in range(230)], identity=True)).cache()
    plain = {o: explore(rows, limit=20, offset=o)[1].collect() for o in (0, 95, 99, 150, 225, 230, 500)}
    for range_rows in (1, 40):
        assert {o: explore(rows, limit=20, offset=o, range_rows=range_rows)[1].collect() for o in plain} == plain
    # Rows that agree in every place, and rows without minutes.
    same = make_stints(*[{"source_player_key": f"k{i}", "player_name": "N", "minutes": None} for i in range(60)], identity=True)
    same = canonical(same).withColumns({"canonical_player_key": F.lit("k"), "minutes": F.lit(None).cast("long")}).cache()
    assert explore(same, limit=20, offset=45, range_rows=5)[1].count() == 15


def test_substring_matches_equal_brute_force(spark):
    import random

    from stintworks.operators.resolve import substring_matches

    dice = random.Random(4)
    names = sorted({"".join(dice.choice("ab") for _ in range(dice.randint(0, 40))) for _ in range(150)})
    texts = sorted({n[i : i + dice.randint(0, 30)] for n in names for i in [dice.randint(0, 9)]} | {"", "zz", "a" * 30})
    got = substring_matches(
        spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(n,) for n in names], "name string"))
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted((t, n) for t in texts for n in names if t in n)
