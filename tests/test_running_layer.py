import random

import pytest
from pyspark.sql import functions as F

from stintworks import workspace
from stintworks.operators.canonical import canonical, canonical_by_source_key
from stintworks.operators.cohorts import moments, similarity_population
from stintworks.plans.running_layer import FOLDS, RunningLayer
from stintworks.plans.store import TableStore


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    return sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(map(repr, b.select(*sorted(a.columns)).collect()))


def random_stints(make_stints, seed):
    pick = random.Random(seed)
    rows = [
        {"batch_id": pick.randrange(4), "season": pick.choice([2024, 2025]), "source_player_key": pick.choice(["a", "b", "c", "d", None]),
         "squad_name": pick.choice(["S", "T", "U", None]), "competition_name": pick.choice(["L", "M"]), "position_raw": pick.choice(["FW", "GK", "MF", None]),
         "minutes": pick.choice([None, 0, 450, 450, 900]), "goals": pick.choice([None, 1, 2]), "born_year": pick.choice([None, 1990, 1991])}
        for _ in range(60)
    ]
    return make_stints(*rows, identity=True)


def test_batches_in_any_order_equal_one_fold(spark, make_stints, tmp_path):
    rows = random_stints(make_stints, 1)
    running = RunningLayer(TableStore(spark, str(tmp_path / "store")), buckets=3)
    for batches in ([2], [0, 3], [1]):
        running.add(rows.filter(F.col("batch_id").isin(batches)))
    whole = canonical(rows).cache()
    assert same(running.canonical(), whole)
    assert same(running.moments(), moments(similarity_population(whole)))


def test_a_batch_counts_once_and_several_may_come_together(spark, make_stints, tmp_path):
    rows = random_stints(make_stints, 3)
    running = RunningLayer(TableStore(spark, str(tmp_path / "store")), key="source_player_key", name="player_name", buckets=2)
    assert running.canonical().count() == running.moments().count() == 0
    first = running.add(rows.filter("batch_id < 2"))
    assert running.add(rows.filter("batch_id < 2")) == first
    running.add(rows)
    assert same(running.canonical(), canonical_by_source_key(rows))
    assert same(running.moments(), moments(similarity_population(canonical_by_source_key(rows))))


def test_a_batch_leaves_other_seasons_alone(spark, make_stints, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    running = RunningLayer(store, buckets=2)
    running.add(make_stints({"batch_id": 1, "season": 2024, "minutes": 1000}, identity=True))
    before = store.manifest()[FOLDS]
    running.add(make_stints({"batch_id": 2, "season": 2025, "minutes": 1000}, identity=True))
    after = store.manifest()[FOLDS]
    assert all(after[p] == folder for p, folder in before.items()) and len(after) == len(before) + 1


def test_a_cohort_that_loses_its_last_row_goes(spark, make_stints, tmp_path):
    running = RunningLayer(TableStore(spark, str(tmp_path / "store")))
    running.add(make_stints({"batch_id": 1, "minutes": 1000, "position_raw": "FW"}, identity=True))
    assert running.moments().count() == 1
    running.add(make_stints({"batch_id": 2, "minutes": 2000, "position_raw": "GK"}, identity=True))
    assert running.moments().count() == 0 and running.canonical().first().position_raw == "GK"


def test_an_unpublished_batch_changes_nothing(spark, make_stints, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path / "store"))
    running = RunningLayer(store)
    one, two = (make_stints({"batch_id": b, "minutes": 1000}, identity=True) for b in (1, 2))
    running.add(one)
    with monkeypatch.context() as m:
        m.setattr(TableStore, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            running.add(two)
    assert running.canonical().first().minutes == 1000
    running.add(two)
    assert running.canonical().first().minutes == 2000
    with pytest.raises(ValueError):
        running.add(make_stints({"batch_id": None}, identity=True))


def test_a_batch_leaves_only_the_stored_parts(spark, make_stints, tmp_path):
    running = RunningLayer(TableStore(spark, str(tmp_path / "store")))
    with workspace.scope(spark):
        running.add(make_stints({"batch_id": 1, "minutes": 1000}, identity=True))
        assert not workspace._SCOPES[-1]
    assert running.canonical().first().minutes == 1000
