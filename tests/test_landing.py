import csv
import datetime as dt
import hashlib
import json
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stintworks.fixtures import registry
from stintworks.operators import constraints
from stintworks.operators.merge import last_per_key, merge_by_key
from stintworks.plans.api_landing import append_raw, land_api_documents, latest_documents, source_registry
from stintworks.plans.season_landing import BATCHES, check_counts, land_into_store, land_season_csv
from stintworks.plans.store import StaleVersion, TableStore
from stintworks.schemas import CSV_COLUMNS, STAGING
from stintworks.sources.api_documents import read_api_containers, read_api_documents
from stintworks.sources.season_csv import read_season_csv, reject_counts, with_row_numbers


def write_csv(path, rows, columns=tuple(CSV_COLUMNS)):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        writer = csv.DictWriter(f, columns)
        writer.writeheader()
        writer.writerows({c: r.get(c, "") for c in columns} for r in rows)
    return str(path)


PLAYER = {"Rk": "1", "Player": 'Kyle "K" É, Jr', "Nation": "fr FRA", "Pos": "FW", "Squad": "Roma", "Comp": "it Serie A", "Age": "26", "Born": "1998",
          "Min": "2,599", "Gls": "25", "SoT%": "40.25%", "+/-": "+12", "G+A-PK": "0.81", "90s": "28.9", "OG": "x"}


@pytest.fixture
def dirs(tmp_path):
    return str(tmp_path / "staging"), str(tmp_path / "batches")


def land(spark, path, dirs, **more):
    return land_season_csv(spark, path, 2025, "2025/26", *dirs, imported_at=dt.datetime(2026, 1, 1), **more)


def test_land_types_and_payload(spark, tmp_path, dirs):
    path = write_csv(tmp_path / "in" / "my season.csv", [PLAYER, {**PLAYER, "Player": "Other", "Nation": "", "Comp": "one", "Min": ""}])
    staging, batches, counts = land(spark, path, dirs)
    one, two = staging.orderBy("source_row_number").collect()
    assert (one.player_name, one.minutes, one.goals, one.plus_minus) == ('Kyle "K" É, Jr', 2599, 25, Decimal("12.00"))
    assert (one.shots_on_target_pct, one.non_penalty_ga_per90, one.nineties) == (Decimal("40.250"), Decimal("0.8100"), Decimal("28.90"))
    assert (one.nation_country_code, one.nation_fifa_code, one.competition_source_code, one.competition_name) == ("fr", "FRA", "it", "Serie A")
    assert one.source_player_key == hashlib.sha256(f"{PLAYER['Player']}|1998|fr FRA".encode()).hexdigest()
    payload = json.loads(one.payload)
    assert list(payload) == list(CSV_COLUMNS) and payload["Min"] == "2,599" and payload["Mn/MP"] is None
    assert (two.nation_raw, two.minutes, two.competition_name, two.own_goals) == ("", None, "", None)
    batch = batches.first()
    raw = open(path, "rb").read()
    assert (batch.file_sha256, batch.row_count, batch.source_filename) == (hashlib.sha256(raw).hexdigest(), 2, "my season.csv")
    assert batch.batch_id == int(batch.file_sha256[:15], 16)
    assert {(r.competition_name, r.rows) for r in counts.collect()} == {("Serie A", 1), ("", 1)}


def test_same_file_twice_and_changed_file(spark, tmp_path, dirs):
    path = write_csv(tmp_path / "a.csv", [PLAYER])
    land(spark, path, dirs)
    first = spark.read.parquet(dirs[0]).collect()
    land_season_csv(spark, path, 2025, "again", *dirs, imported_at=dt.datetime(2026, 1, 1))
    assert len(spark.read.parquet(dirs[0]).collect()) == len(first) == 1
    batch = spark.read.parquet(dirs[1]).collect()
    assert len(batch) == 1 and batch[0].season_label == "again"
    write_csv(tmp_path / "a.csv", [PLAYER, {**PLAYER, "Player": "New"}])
    land(spark, path, dirs)
    assert spark.read.parquet(dirs[0]).count() == 3 and spark.read.parquet(dirs[1]).count() == 2


def test_created_time_survives_a_reload(spark, tmp_path, dirs):
    path = write_csv(tmp_path / "a.csv", [PLAYER])
    land(spark, path, dirs)
    land_season_csv(spark, path, 2025, "x", *dirs, imported_at=dt.datetime(2027, 1, 1))
    batch = spark.read.parquet(dirs[1]).first()
    assert batch.created_at == dt.datetime(2026, 1, 1) and batch.imported_at == dt.datetime(2027, 1, 1)


def test_folder_of_files_numbers_each_file(spark, tmp_path, dirs):
    for name, n in {"a": 3, "b": 5}.items():
        write_csv(tmp_path / "in" / f"{name}.csv", [{**PLAYER, "Rk": str(i), "Player": name} for i in range(1, n + 1)])
    write_csv(tmp_path / "in" / "copy of a.csv", [{**PLAYER, "Rk": str(i), "Player": "a"} for i in range(1, 4)])
    staging, batches, _ = land(spark, str(tmp_path / "in"), dirs)
    assert batches.count() == 2 and staging.count() == 8
    assert staging.filter("source_row_number <> source_rank").isEmpty()


def test_row_numbers_follow_the_file_across_splits(spark, tmp_path):
    path = write_csv(tmp_path / "big.csv", [{**PLAYER, "Rk": str(i)} for i in range(1, 3001)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = read_season_csv(spark, path)
        assert raw.rdd.getNumPartitions() > 5
        assert with_row_numbers(raw).filter("source_row_number <> int(Rk)").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_missing_columns_and_empty_file(spark, tmp_path):
    with pytest.raises(ValueError, match="Squad"):
        read_season_csv(spark, write_csv(tmp_path / "a.csv", [PLAYER], [c for c in CSV_COLUMNS if c != "Squad"]))
    with pytest.raises(ValueError, match="PKm"):
        read_season_csv(spark, write_csv(tmp_path / "b.csv", [PLAYER], [c for c in CSV_COLUMNS if c != "PKm"]))
    with pytest.raises(ValueError, match="no rows"):
        read_season_csv(spark, write_csv(tmp_path / "c.csv", []))


def test_rejects(spark, tmp_path, dirs):
    path = write_csv(tmp_path / "a.csv", [PLAYER, {**PLAYER, "90s": "12345678.5"}])
    assert {(r["column"], r.rejects) for r in reject_counts(read_season_csv(spark, path)).collect()} == {("OG", 2), ("90s", 1)}
    with pytest.raises(ValueError, match="OG: 2"):
        land(spark, path, dirs, strict=True)


def test_count_mismatch_is_an_error(spark, tmp_path, dirs):
    staging, batches, _ = land(spark, write_csv(tmp_path / "a.csv", [PLAYER] * 2), dirs)
    with pytest.raises(ValueError, match="loaded 2 of 3"):
        check_counts(staging, batches.withColumn("row_count", F.lit(3)))


def document(player="Lamine", pid=7, errors=(), entries=None, minutes=900, league=140, season=2025, teams=(1,)):
    statistic = [
        {"league": {"id": league, "name": "La Liga", "country": "Spain", "season": season}, "team": {"id": t, "name": f"T{t}"},
         "games": {"position": "Attacker", "number": None, "appearences": 10, "minutes": minutes, "rating": "7.345"},
         "goals": {"total": 5}, "penalty": {"commited": 1}}
        for t in teams
    ]
    if entries is None:
        entries = [{"player": {"id": pid, "name": player, "firstname": " ", "height": "185 cm", "weight": None, "birth": {"date": "2007-07-13"}}, "statistics": statistic}]
    return json.dumps({"errors": list(errors) if not isinstance(errors, dict) else errors, "response": entries})


def api(spark, *docs, search="lam", league=140, season=2025):
    rows = [(f"d{i}", d, dt.datetime(2026, 1, 1 + i)) for i, d in enumerate(docs)]
    documents = spark.createDataFrame(rows, "document_id string, payload string, fetched_at timestamp")
    requests = spark.createDataFrame([(f"d{i}", search, league, season) for i in range(len(docs))], "document_id string, search string, league long, season int")
    return documents, requests


def test_api_documents_land_in_the_star(spark):
    first = json.loads(document("Nobody", 1))["response"] + json.loads(document("Lamine Yamal", 7, teams=(1, 2)))["response"]
    out = land_api_documents(*api(spark, document(entries=first), document("Lamine Y.", 7, minutes=1000)))
    player = out.player.collect()
    assert [(p.api_football_id, p.name, p.firstname, p.height_cm, p.weight_kg, str(p.birth_date)) for p in player] == [(7, "Lamine Y.", None, 185, None, "2007-07-13")]
    stats = {(s.player_id, s.team_id): s for s in out.stats.collect()}
    assert set(stats) == {(7, 1), (7, 2)} and stats[7, 1].minutes == 1000 and stats[7, 2].minutes == 900
    assert stats[7, 1].rating == Decimal("7.35") and stats[7, 1].penalties_committed == 1 and stats[7, 1].source_id == 1 and stats[7, 1].shirt_number is None
    assert {t.name for t in out.team.collect()} == {"T1", "T2"} and out.competition.first().country == "Spain" and out.competition_season.first().is_current is False
    assert out.rejects.isEmpty() and out.summary.count() == 3
    latest = latest_documents(out.raw).collect()
    assert len(latest) == 1 and json.loads(latest[0].request_params) == {"search": "lam", "league": 140, "season": 2025}
    assert "1000" in latest[0].payload


def test_rejected_documents(spark):
    docs = [document(errors={"token": "bad"}), document(entries=[]), document(league=39), document(errors=["x"]), "not json", document(season=2024)]
    out = land_api_documents(*api(spark, *docs))
    assert [r.reject_reason for r in out.rejects.orderBy("document_id").collect()] == ["API_ERRORS", "NO_ENTRIES", "NO_STATISTICS", "API_ERRORS", "NO_ENTRIES", "NO_STATISTICS"]
    assert out.stats.isEmpty() and out.raw.isEmpty()


@pytest.mark.parametrize("search, expected", [("LAM", 7), ("l*e", 7), ("l?mine", 7), ("zzz", 1), ("l.mine", 1), ("[kl]am", 7)])
def test_entry_choice(spark, search, expected):
    entries = json.loads(document("First", 1))["response"] + json.loads(document("Lamine", 7))["response"]
    out = land_api_documents(*api(spark, document(entries=entries), search=search))
    assert [p.api_football_id for p in out.player.collect()] == [expected]


def test_landing_again_updates_named_columns_only(spark):
    team = spark.createDataFrame([(1, "Old", "COD", "Spain", 1900, False, None, None)], "api_football_id int, name string, code string, country string, founded int, is_national boolean, logo_url string, updated_at timestamp")
    once = land_api_documents(*api(spark, document()), existing={"team": team})
    row = once.team.first()
    assert (row.name, row.code, row.founded) == ("T1", "COD", 1900)
    tables = {"player": once.player, "competition": once.competition, "competition_season": once.competition_season, "team": once.team, "stats": once.stats}
    again = land_api_documents(*api(spark, document()), existing=tables)
    for name in tables:
        assert sorted(map(str, getattr(again, name).collect())) == sorted(map(str, tables[name].collect()))


def test_read_documents_and_append_raw(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "one.json").write_text(json.dumps(json.loads(document()), indent=1))
    documents = read_api_documents(spark, str(tmp_path / "docs"))
    requests = spark.createDataFrame([("one.json", "lam", 140, 2025)], "document_id string, search string, league long, season int")
    out = land_api_documents(documents, requests)
    for _ in range(2):
        append_raw(out.raw, str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 2 and out.player.count() == 1


def test_merge_modes(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "n", "z")], "k int, v string, w string")
    updates = spark.createDataFrame([(1, "late", 2), (1, "early", 1), (3, "c", 1), (None, "m", 1)], "k int, v string, seq int")
    updated = {(r.k, r.v, r.w) for r in merge_by_key(target, updates, ["k"], ["v"], ["seq"]).collect()}
    assert updated == {(1, "late", "x"), (2, "b", "y"), (3, "c", None), (None, "n", "z"), (None, "m", None)}
    ignored = {(r.k, r.v, r.w) for r in merge_by_key(target, updates, ["k"], [], ["seq"], mode="ignore").collect()}
    assert ignored == {(1, "a", "x"), (2, "b", "y"), (3, "c", None), (None, "n", "z"), (None, "m", None)}
    with pytest.raises(ValueError):
        merge_by_key(target, updates, ["k"], [], mode="other")


def test_merge_can_set_null(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    updates = spark.createDataFrame([(1, None)], "k int, v string")
    assert merge_by_key(target, updates, ["k"], ["v"]).first().v is None


def test_source_registry_variants(spark):
    registry = source_registry(spark)
    fresh = spark.createDataFrame([(9, "API_FOOTBALL", "renamed", None)], "id long, code string, name string, base_url string")
    ignored = merge_by_key(registry, fresh, ["code"], [], mode="ignore")
    assert {r.name for r in ignored.collect()} == {r.name for r in registry.collect()}
    row = merge_by_key(registry, fresh, ["code"], ["name"]).filter("code = 'API_FOOTBALL'").first()
    assert (row.id, row.name, row.base_url) == (1, "renamed", "https://v3.football.api-sports.io")


def test_last_per_key(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (2, 2, None)], "k int, seq int, v string")
    assert {tuple(r) for r in last_per_key(rows, ["k"], ["seq"]).collect()} == {(1, 3, "c"), (2, 2, None)}


def test_constraints(spark):
    child = spark.createDataFrame([(1, "ab"), (1, "abc"), (None, None), (None, None), (5, "x")], "p int, t string")
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    assert constraints.null_violations(child, ["t"]).count() == 2
    assert [tuple(r) for r in constraints.unique_violations(child, ["p"]).collect()] == [(1, 2)]
    assert [r.p for r in constraints.foreign_key_violations(child, parent, {"p": "id"}).collect()] == [5]
    assert [r.t for r in constraints.length_violations(child, {"t": 2}).collect()] == ["abc"]
    assert constraints.cascade(child, parent, {"p": "id"}).count() == 4  # rows without a key have no parent to lose


def test_names_that_differ_by_their_escapes_are_two_files(spark, tmp_path, dirs):
    folder = tmp_path / "in"
    write_csv(folder / "a b.csv", [PLAYER] * 6)
    write_csv(folder / "a%20b.csv", [{**PLAYER, "Player": "Other"}] * 2)
    staging, batches, _ = land(spark, str(folder), dirs)
    assert staging.count() == 8
    assert {(b.source_filename, b.row_count) for b in batches.collect()} == {("a b.csv", 6), ("a%20b.csv", 2)}
    assert {b.file_sha256 for b in batches.collect()} == {hashlib.sha256(p.read_bytes()).hexdigest() for p in folder.iterdir()}


def test_a_file_without_a_hash_stops_the_load(spark, tmp_path, dirs, monkeypatch):
    from stintworks.plans import season_landing

    folder = tmp_path / "in"
    write_csv(folder / "one.csv", [PLAYER])
    write_csv(folder / "two.csv", [{**PLAYER, "Player": "Other"}])
    found = season_landing.file_hashes
    monkeypatch.setattr(season_landing, "file_hashes", lambda s, p: found(s, p).filter("_file LIKE '%one.csv'"))
    with pytest.raises(ValueError, match="two.csv"):
        land(spark, str(folder), dirs)


def test_rows_lost_after_counting_stop_the_load(spark, tmp_path, dirs, monkeypatch):
    from stintworks.plans import season_landing

    path = write_csv(tmp_path / "a.csv", [PLAYER, {**PLAYER, "Player": "Other"}])
    number = season_landing.with_row_numbers
    monkeypatch.setattr(season_landing, "with_row_numbers", lambda rows: number(rows).filter("source_row_number = 1"))
    with pytest.raises(ValueError, match="loaded 1 of 2"):
        land(spark, path, dirs)


@pytest.mark.parametrize("mode", ["update", "ignore"])
def test_keyless_updates_all_stay(spark, mode):
    target = spark.createDataFrame([(1, "a"), (None, "b")], "key int, v string")
    updates = spark.createDataFrame([(None, "x", 1), (None, "y", 2), (None, "z", 3), (1, "n", 1), (1, "m", 2)], "key int, v string, at int")
    merged = merge_by_key(target, updates, ["key"], ["v"], ["at"], mode)
    kept = "m" if mode == "update" else "a"
    assert sorted(merged.collect(), key=repr) == sorted([(1, kept), (None, "b"), (None, "x"), (None, "y"), (None, "z")], key=repr)


def test_cascade_keeps_rows_without_a_parent_key(spark):
    child = spark.createDataFrame([(1, 5), (2, None), (3, 6)], "id int, parent int")
    parents = spark.createDataFrame([(5,)], "id int")
    assert sorted(r.id for r in constraints.cascade(child, parents, {"parent": "id"}).collect()) == [1, 2]


def test_every_document_and_request_is_loaded_or_rejected(spark):
    def document(player='{"id": 1, "name": "Ana"}', minutes="90", team='{"id": 3, "name": "T"}'):
        return f'{{"errors": [], "response": [{{"player": {player}, "statistics": [{{"league": {{"id": 7, "name": "L", "season": 2025}}, "team": {team}, "games": {{"minutes": {minutes}}}}}]}}]}}'

    payloads = {
        "good": document(), "half": document(minutes="12.5"), "bad": document(minutes='"x"'), "team": document(team='{"name": "T"}'),
        "name": document(player='{"id": 1}'), "person": document(player='{"name": "Ana"}'), "letters": document(player='{"id": "x1", "name": "Ana"}'), "unasked": document(),
    }
    documents = spark.createDataFrame([(k, v, dt.datetime(2026, 1, 1)) for k, v in payloads.items()], "document_id string, payload string, fetched_at timestamp")
    asked = spark.createDataFrame([(k, "ana", 7, 2025) for k in [*payloads, "missing"] if k != "unasked"], "document_id string, search string, league long, season int")
    landing = land_api_documents(documents, asked)
    assert {r.document_id: r.minutes for r in landing.summary.collect()} == {"good": 90, "half": 12}
    assert {r.document_id: r.reject_reason for r in landing.rejects.collect()} == {
        "bad": "BAD_NUMBER", "letters": "BAD_NUMBER", "team": "NO_DIMENSION_KEY", "name": "NO_PLAYER_KEY", "person": "NO_PLAYER_KEY",
        "unasked": "NO_REQUEST", "missing": "NO_DOCUMENT",
    }


@pytest.mark.parametrize("missing,lost", [(None, 0), ("five", 1), ("same", 2)])
def test_every_document_goes_through_containers(spark, monkeypatch, missing, lost):
    payloads = {1: "same", 2: "same", 5: "five", 7: "seven\nlines", 8: "", 57: "é 57", 60: '{"a": [1,  2]}'}
    at = dt.datetime(2026, 1, 2, 3, 4, 5)
    documents = spark.createDataFrame([(str(k), v, at) for k, v in payloads.items()], "document_id string, payload string, fetched_at timestamp")
    monkeypatch.setattr(registry.adapter, "api_documents", lambda spark, sf_dir: (documents, None))
    read = []

    def reader(spark, path):
        read.append(read_api_containers(spark, path))
        return read[0].filter(~F.startswith("payload", F.lit(missing))) if missing else read[0]

    monkeypatch.setattr(registry, "read_api_containers", reader)
    found = len(payloads) - lost
    assert dict(registry.QUERIES["api_files"](spark, "").collect()) == {"documents": found, "payloads": found, "lost": lost}
    assert read[0].count() == len(payloads)


def test_containers_take_lines_of_any_kind(spark, tmp_path):
    lines = ['{"document_id": "a", "payload": "{\\"x\\": 1}", "fetched_at": "2026-01-02T00:00:00Z"}', '{"payload": {"y": [1]}}', "no json", ""]
    (tmp_path / "many.ndjson").write_text("\n".join(lines) + "\n")
    rows = read_api_containers(spark, str(tmp_path)).collect()
    assert sorted((r.document_id, r.payload) for r in rows) == sorted(
        [("a", '{"x": 1}'), ("many.ndjson", '{"y":[1]}'), ("many.ndjson", "no json"), ("many.ndjson", "")])
    assert {r.fetched_at for r in rows if r.document_id == "a"} == {dt.datetime(2026, 1, 2)} and {r.container for r in rows} == {"many.ndjson"}


def test_malformed_records_come_back_with_their_place(spark, tmp_path):
    path = write_csv(tmp_path / "in" / "a.csv", [{**PLAYER, "Player": f"P{i}"} for i in range(6)])
    lines = open(path, encoding="utf-8").read().splitlines()
    lines[2] += ",one more"
    lines[5] = ",".join(lines[5].split(",")[:-2])
    open(path, "w", encoding="utf-8").write("\n".join(lines) + "\n")
    store = TableStore(spark, str(tmp_path / "store"))
    landing = land_into_store(store, path, 2025, "x", keep_malformed=True)
    assert sorted((r.player_name, r.source_row_number) for r in landing.staging.collect()) == [("P0", 1), ("P2", 3), ("P3", 4), ("P5", 6)]
    bad = sorted((r.record_number, r.record[-8:], r.source_filename) for r in landing.malformed.collect())
    assert [(n, f) for n, _, f in bad] == [(2, "a.csv"), (5, "a.csv")] and bad[0][1] == "one more"
    assert landing.batches.first().row_count == 4


def test_a_load_that_is_not_published_leaves_the_store(spark, tmp_path, monkeypatch):
    one = write_csv(tmp_path / "one.csv", [PLAYER])
    two = write_csv(tmp_path / "two.csv", [PLAYER, {**PLAYER, "Player": "Other"}])
    store = TableStore(spark, str(tmp_path / "store"))
    assert land_into_store(store, one, 2025, "x").staging.count() == 1
    with monkeypatch.context() as m:
        m.setattr(TableStore, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            land_into_store(store, two, 2025, "x")
    assert store.version() == 1 and store.read("staging", STAGING).count() == store.read("batches", BATCHES).count() == 1
    land_into_store(store, two, 2025, "x")
    land_into_store(store, one, 2025, "again")
    assert store.read("staging", STAGING).count() == 3 and store.version() == 3
    assert {(r.row_count, r.season_label) for r in store.read("batches", BATCHES).collect()} == {(1, "again"), (2, "x")}
    with pytest.raises(StaleVersion):
        store.publish({}, 1)


def test_stored_merges_equal_merges_of_frames(spark, tmp_path):
    import random

    dice = random.Random(5)
    schema = "a int, b string, v string, w int"
    store, frame = TableStore(spark, str(tmp_path / "store")), spark.createDataFrame([], schema)
    for round_ in range(4):
        rows = [(dice.choice([None, *range(9)]), dice.choice("xyz"), f"{round_}-{i}", i) for i in range(12)]
        updates = last_per_key(spark.createDataFrame(rows, schema), ["a", "b"], ["w"]).cache()
        columns, mode = (["v"], "update") if round_ % 2 == 0 else (["v", "w"], "ignore")
        frame = merge_by_key(frame, updates, ["a", "b"], columns, mode=mode)
        store.publish(store.stage_merge("t", schema, updates, ["a", "b"], columns, mode=mode, buckets=5), store.version())
        assert sorted(map(repr, store.read("t", schema).collect())) == sorted(map(repr, frame.collect()))
    before = store.manifest()["t"]
    one = spark.createDataFrame([(1, "x", "new", 0)], schema)
    store.publish(store.stage_merge("t", schema, one, ["a", "b"], ["v"], buckets=5), store.version())
    after = store.manifest()["t"]
    assert sum(after[p] != before.get(p) for p in after) == 1


def test_entity_ids_of_raw_documents_read_like_those_of_players(spark):
    payload = json.dumps({"response": [{"player": {"id": "12.0", "name": "Kyle"}, "statistics": [
        {"league": {"id": 1, "season": 2025, "name": "L"}, "team": {"id": 2, "name": "T"}, "games": {"minutes": 5}}]}]})
    documents = spark.createDataFrame([("d", payload, dt.datetime(2026, 1, 1))], "document_id string, payload string, fetched_at timestamp")
    asked = spark.createDataFrame([("d", "kyle", 1, 2025)], "document_id string, search string, league int, season int")
    landing = land_api_documents(documents, asked)
    assert landing.raw.first().entity_api_id == landing.player.first().api_football_id == 12


def test_rows_are_written_without_sorting_them_by_batch(spark, tmp_path, dirs):
    for name, n in {"a": 3, "b": 5}.items():
        write_csv(tmp_path / "in" / f"{name}.csv", [{**PLAYER, "Rk": str(i), "Player": name} for i in range(1, n + 1)])
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting, None)
    staging = land(spark, str(tmp_path / "in"), dirs).staging
    assert sorted((r.player_name, r.source_row_number) for r in staging.collect()) == [("a", i) for i in range(1, 4)] + [("b", i) for i in range(1, 6)]
    assert spark.conf.get(setting, None) == before
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    writes = [p for p in plans if "InsertIntoHadoopFsRelationCommand" in p and dirs[0] in p]
    assert writes and not any("Sort (" in p for p in writes)


def test_a_landing_keeps_no_copy_of_the_text_and_moves_no_row(spark, tmp_path):
    from stintworks import workspace

    path = write_csv(tmp_path / "a.csv", [PLAYER, {**PLAYER, "Player": "Other"}])
    store = TableStore(spark, str(tmp_path / "store"))
    staged = {}

    class Watched(TableStore):
        def stage(self, table, rows, part, **options):
            staged[table] = options
            return super().stage(table, rows, part, **options)

    with workspace.scope(spark):
        landing = land_into_store(Watched(spark, store.root), path, 2025, "x")
        names = [p.rsplit("/", 1)[1] for p in workspace._SCOPES[-1] if os.path.exists(p.removeprefix("file:"))]
        assert landing.staging.count() == 2 and landing.malformed.count() == 0
    assert names and not [n for n in names if n.startswith("season-csv-")]
    assert staged["staging"] == {"together": True}
