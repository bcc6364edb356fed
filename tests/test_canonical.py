from decimal import Decimal

from pyspark.sql import functions as F

from stintworks.operators.canonical import canonical, canonical_by_source_key, latest_batch_per_season
from stintworks.operators.identity import IDENTITY, build_overrides, collision_report, narrowed, resolve_identity
from stintworks.operators.views import intelligence_base, season_analysis
from stintworks import workspace
from stintworks.schemas import OVERRIDES, SUMMED


def one(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0]


def test_two_stints_fold_into_one(make_stints):
    row = one(canonical(make_stints(
        {"squad_name": "B", "minutes": 300, "goals": 1, "age": Decimal("25.00"), "position_raw": "MF"},
        {"squad_name": "A", "minutes": 700, "goals": 4, "age": Decimal("24.00"), "position_raw": "FW"}, identity=True)))
    assert (row.minutes, row.goals, row.stint_count) == (1000, 5, 2)
    assert (row.primary_squad_name, row.squad_names, row.position_group) == ("A", "A | B", "FW")
    assert row.age == Decimal("25.00")
    assert row.is_similarity_eligible and row.sample_quality == "MEDIUM"


def test_equal_minutes_take_the_earlier_row(make_stints):
    rows = make_stints({"squad_name": "X", "minutes": 500, "source_row_number": 2}, {"squad_name": "Y", "minutes": 500, "source_row_number": 1}, identity=True)
    assert one(canonical(rows)).primary_squad_name == "Y"


def test_null_minutes_come_last(make_stints):
    row = one(canonical(make_stints({"squad_name": "A", "minutes": None}, {"squad_name": "B", "minutes": 0}, identity=True)))
    assert (row.primary_squad_name, row.minutes, row.shots_per90, row.sample_quality) == ("B", 0, None, "LOW")
    assert row.is_similarity_eligible is False


def test_blank_position_is_eligible_null_is_not(make_stints):
    rows = make_stints(*[{"source_player_key": str(i), "position_raw": p, "minutes": 1000} for i, p in enumerate(["", None, "GK", "GK,MF"])])
    got = {r.source_player_key: r.is_similarity_eligible for r in canonical_by_source_key(rows).collect()}
    assert got == {"0": True, "1": False, "2": False, "3": True}


def test_override_splits_a_shared_key(spark, make_stints):
    stints = make_stints({"squad_name": "Genoa", "minutes": 900, "nation_fifa_code": "POR", "born_year": 2000},
                         {"squad_name": "PSG", "minutes": 1900, "nation_fifa_code": "POR", "born_year": 2000})
    rules = spark.createDataFrame(
        [("P", 2000, "POR", "Genoa", "P:1", "known"), ("P", 2000, "POR", "PSG", "P:2", "known")],
        "player_name string, born_year int, nation_fifa_code string, squad_name string, canonical_player_key string, resolution_reason string")
    overrides = build_overrides(stints, rules)
    resolved = resolve_identity(stints, overrides)
    rows = {r.canonical_player_key: r for r in canonical(resolved).collect()}
    assert {k: r.stint_count for k, r in rows.items()} == {"P:1": 1, "P:2": 1}
    assert rows["P:1"].source_player_key == "p"
    # An override never changes totals.
    before = canonical_by_source_key(stints).agg(*[F.sum(c).alias(c) for c in SUMMED]).first()
    after = canonical(resolved).agg(*[F.sum(c).alias(c) for c in SUMMED]).first()
    assert before == after


def test_override_conflict_last_wins_and_replaces(spark, make_stints):
    stints = make_stints({"born_year": 1, "nation_fifa_code": "N"}, {"born_year": 1, "nation_fifa_code": "N"})
    rule = "player_name string, born_year int, nation_fifa_code string, squad_name string, canonical_player_key string, resolution_reason string"
    existing = spark.createDataFrame([("p", 2025, "A", "L", "old", "P", "old"), ("q", 2025, "A", "L", "kept", "Q", "old")], OVERRIDES)
    built = build_overrides(stints, spark.createDataFrame([("P", 1, "N", "A", "new", "r")], rule), existing)
    assert {(r.source_player_key, r.canonical_player_key, r.resolution_reason) for r in built.collect()} == {("p", "new", "r"), ("q", "kept", "old")}


def test_unresolved_rows_pass_through(spark, make_stints):
    row = one(resolve_identity(make_stints({}), spark.createDataFrame([], OVERRIDES)))
    assert (row.canonical_player_key, row.canonical_player_name, row.identity_overridden) == ("p", "P", False)


def test_collision_report_needs_squads_and_groups(make_stints):
    rows = make_stints(
        {"source_player_key": "a", "squad_name": "X", "position_raw": "FW"}, {"source_player_key": "a", "squad_name": "Y", "position_raw": "MF"},
        {"source_player_key": "b", "squad_name": "X"}, {"source_player_key": "b", "squad_name": "Y"},
        {"source_player_key": "c", "position_raw": "FW"}, {"source_player_key": "c", "position_raw": "MF"})
    row = one(collision_report(rows))
    assert (row.source_player_key, row.stint_count, row.squad_count, row.group_count, row.squad_names) == ("a", 2, 2, 2, "X | Y")


def test_result_ignores_order_and_partitions(make_stints):
    rows = make_stints(*[{"source_player_key": f"k{i % 7}", "squad_name": f"S{i % 5}", "minutes": i % 3 * 400, "goals": i} for i in range(200)])
    plain = sorted(map(tuple, canonical_by_source_key(rows).collect()))
    moved = sorted(map(tuple, canonical_by_source_key(rows.orderBy(F.rand(1)).repartition(7)).collect()))
    assert plain == moved


def test_stints_and_sums_are_preserved(make_stints):
    rows = make_stints(*[{"source_player_key": f"k{i % 7}", "minutes": i} for i in range(100)])
    total = canonical_by_source_key(rows).agg(F.sum("stint_count"), F.sum("minutes")).first()
    assert tuple(total) == (100, sum(range(100)))


def test_second_batch_doubles_unless_latest_is_asked(make_stints):
    import datetime as dt

    rows = make_stints({"minutes": 500, "batch_id": 7}, {"minutes": 600, "batch_id": 3, "imported_at": dt.datetime(2026, 2, 1)})
    assert one(canonical_by_source_key(rows)).minutes == 1100
    assert one(canonical_by_source_key(latest_batch_per_season(rows))).minutes == 600


def test_one_shuffle_of_the_stints(make_stints):
    import contextlib
    import io

    rows = make_stints(*[{"minutes": i} for i in range(20)])
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        canonical_by_source_key(rows).explain()
    assert text.getvalue().count("Exchange") == 1


def test_intelligence_base(make_stints):
    rows = intelligence_base(make_stints(
        {"position_raw": "GK", "minutes": 1800, "saves": 40}, {"position_raw": None, "minutes": 1800}, {"minutes": None, "goals": 3})).orderBy("id").collect()
    assert [r.is_similarity_eligible for r in rows] == [True, False, False]
    assert [r.role_family for r in rows] == ["GOALKEEPER", "UNKNOWN", "FORWARD"]
    assert rows[0].saves_per90 == Decimal("2.0000") and rows[2].goals_per90 is None and rows[2].sample_quality == "LOW"
    assert len(rows[0]) == 66 + 18


def test_season_analysis(spark):
    stats = "season int, position string, appearances int, starts int, minutes int, rating decimal(5,2), goals int, assists int, penalties_scored int, penalties_missed int, shots_total int, shots_on int, passes_total int, passes_key int, duels_total int, duels_won int, dribbles_attempts int, dribbles_success int"
    frame = spark.createDataFrame(
        [(1, 1, 1, 2025, "F", 1, 1, 1000, Decimal("7.00"), 3, None, 1, 0, 9, 6, 1, None, 0, 0, 3, 2), (9, 1, 1, 2025, *[None] * 17)],
        "player_id long, team_id long, competition_id long, " + stats)
    row = one(season_analysis(
        frame, spark.createDataFrame([(1, 11, "N", "es")], "id long, api_football_id int, name string, nationality string"),
        spark.createDataFrame([(1, "T")], "id long, name string"), spark.createDataFrame([(1, "C", "x")], "id long, name string, country string")))
    assert row.goals_per_90 == Decimal("0.27") and row.assists_per_90 is None and row.goal_contributions == 3
    assert row.goal_conversion_pct == Decimal("33.33") and row.shots_on_pct == Decimal("66.67") and row.duels_won_pct is None
    assert row.minutes_per_goal == Decimal("333.33") and row.non_penalty_goals == 2 and row.key_passes_per_90 is None
    assert len(row) == 27 + 14


def test_overrides_meet_stints_without_four_keys(spark, make_stints):
    """Stints shuffle by source key and season alone; equal overrides count as often as they come, NULL keys never match."""
    stints = make_stints({"squad_name": "A"}, {"squad_name": "B"}, {"squad_name": None}, {"source_player_key": None, "squad_name": "A"})
    schema = "source_player_key string, season int, squad_name string, competition_name string, canonical_player_key string, canonical_player_name string"
    rules = spark.createDataFrame([("p", 2025, "A", "L", "p:A", "X"), ("p", 2025, "A", "L", "p:A", "X"), ("p", 2025, None, "L", "no", "N")], schema)
    found = resolve_identity(stints, rules)
    got = sorted((str(r.squad_name), str(r.canonical_player_key), r.identity_overridden) for r in found.collect())
    assert got == [("A", "None", False), ("A", "p:A", True), ("A", "p:A", True), ("B", "p", False), ("None", "p", False)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = resolve_identity(stints, rules)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(source_player_key" in plan and "squad_name" not in "".join(
        part.split(")")[0] for part in plan.split("hashpartitioning(")[1:])


def test_rows_that_no_rule_names_are_left_out_before_the_join(spark, make_stints):
    who = [{"player_name": f"P{i}", "born_year": 1990 + i % 3, "nation_fifa_code": "FRA" if i % 2 else None} for i in range(200)]
    rules = spark.createDataFrame([(f"P{i}", 1990 + i % 3, "FRA" if i % 2 else None) for i in range(20)], "player_name string, born_year long, nation_fifa_code string")
    kept = narrowed(make_stints(*who), rules, IDENTITY)
    names = {r.player_name for r in kept.collect()}
    assert names >= {f"P{i}" for i in range(20)} and len(names) < 40
    assert "_number" not in kept.columns


def test_many_stints_are_dealt_over_tasks_of_bounded_size(spark, make_stints, monkeypatch):
    stints = make_stints(*[{"source_player_key": f"p{i % 40}", "minutes": i, "goals": 1} for i in range(400)])
    override = spark.createDataFrame([("p3", 2025, "A", "L", "other", "Other", "why")], OVERRIDES)
    expected = sorted(canonical(resolve_identity(stints, override)).collect())
    monkeypatch.setattr(workspace, "TASK_ROWS", 50)
    resolved = resolve_identity(stints, override)
    assert resolved.rdd.getNumPartitions() == 8
    assert sorted(canonical(resolved).collect()) == expected
