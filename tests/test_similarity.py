import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stintworks.functions.blocks import _Block, _nearest_of
from stintworks.operators.cohorts import moments
from stintworks.operators.neighbours import CHUNK_ROWS, _sharing, build_index, nearest, rank_of
from stintworks.operators.similarity import (
    all_targets, build_space, candidate_ranks, cohort_outcomes, compare_metrics, explain_cosine, explain_euclidean,
    _indexes, find_candidates, nth_neighbour, role_experiment, role_neighbours, top_features,
)
from stintworks.schemas import FEATURES, ROLE_FEATURES

METRICS = ["euclidean", "manhattan", "cosine"]


def points(seed=0, n=700, dims=5):
    """Two cohorts, one crowded; rounded values, repeated vectors, zero vectors and repeated keys."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        vec = np.round(rng.normal(size=dims), 1)
        if i % 3 == 0:
            vec = np.array([0.5, -0.5, 1.0, 0.0, 2.0])[:dims]
        if i % 50 == 1:
            vec = np.zeros(dims)
        key = f"k{i:04d}" if i % 11 else f"k{i // 22:04d}"
        rows.append(("big" if i % 7 else "small", key, 2000 + i, [float(x) for x in vec]))
    return rows


def score(a, b, metric):
    a, b = np.array(a), np.array(b)
    if metric == "euclidean":
        return math.sqrt(((a - b) ** 2).sum())
    if metric == "manhattan":
        return float(np.abs(a - b).sum())
    norm = math.sqrt((a * a).sum()) * math.sqrt((b * b).sum())
    return float(a @ b / norm) if norm else 0.0


def order(row, target, metric):
    s = math.floor((-1 if metric == "cosine" else 1) * score(target[3], row[3], metric) * 1e6 + 0.5)
    return (s, row[1], row[2])


def brute(rows, metric, k):
    best = {}
    for t in rows:
        others = [r for r in rows if r[0] == t[0] and r[1] != t[1]]
        best[t[2]] = [(r[1], r[2]) for r in sorted(others, key=lambda r: order(r, t, metric))[:k]]
    return best


@pytest.fixture(scope="module")
def cloud(spark):
    rows = points()
    frame = spark.createDataFrame(rows, "cohort string, key string, season int, vec array<double>").repartition(5).cache()
    return rows, frame, frame.select(F.col("season").alias("target_id"), "cohort", "key", "vec")


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("chunk_rows", [40, 4096])
def test_nearest_equals_brute_force(cloud, metric, chunk_rows):
    rows, frame, targets = cloud
    index = build_index(frame, 5, metric, 8, chunk_rows)
    assert index.single == (chunk_rows == 4096)
    assert index.single or index.cells.filter("cohort = 'big'").count() > 8
    got = {}
    for r in nearest(targets, index, 7, chunk_rows).orderBy("target_id", "rank").collect():
        got.setdefault(r.target_id, []).append((r.key, r.season))
        by_id = rows[r.target_id - 2000], rows[r.season - 2000]
        assert r.score == pytest.approx(score(by_id[0][3], by_id[1][3], metric), abs=1e-9)
    assert got == brute(rows, metric, 7)


def test_targets_outside_the_candidates(spark, cloud):
    rows, frame, _ = cloud
    asked = [(i, "big", f"new{i}", [float(x) for x in np.random.default_rng(i).normal(size=5) * 3]) for i in range(20)]
    targets = spark.createDataFrame(asked, "target_id int, cohort string, key string, vec array<double>")
    got = {}
    for r in nearest(targets, build_index(frame, 5, "euclidean", 6, 40), 5, 40).orderBy("target_id", "rank").collect():
        got.setdefault(r.target_id, []).append((r.key, r.season))
    expected = {
        i: [(r[1], r[2]) for r in sorted((r for r in rows if r[0] == c), key=lambda r: order(r, (c, k, 0, v), "euclidean"))[:5]]
        for i, c, k, v in asked
    }
    assert got == expected


def test_targets_have_a_k_of_their_own(cloud):
    rows, frame, targets = cloud
    mixed = targets.withColumn("k", F.when(F.col("target_id") % 50 == 0, 100_000).otherwise(F.col("target_id") % 6 + 1).cast("int"))
    want, sizes = brute(rows, "euclidean", 6), {c: sum(r[0] == c for r in rows) for c in {r[0] for r in rows}}
    for index, chunk in ((build_index(frame, 5, "euclidean", None, 40), 40), (build_index(frame, 5, "euclidean", None), 4096)):
        got = {}
        for r in nearest(mixed, index, 1, chunk).orderBy("target_id", "rank").collect():
            got.setdefault(r.target_id, []).append((r.key, r.season))
        for t, found in got.items():
            if t % 50:
                assert found == want[t][: t % 6 + 1]
            else:
                own = [r for r in rows if r[2] == t][0]
                assert found[:6] == want[t] and len(found) == sum(r[0] == own[0] and r[1] != own[1] for r in rows) <= sizes[own[0]]


def test_a_forced_tree_gives_the_same(cloud):
    rows, frame, targets = cloud
    index = build_index(frame, 5, "euclidean", 4, force_tree=True)
    assert not index.single
    got = {}
    for r in nearest(targets, index, 3).orderBy("target_id", "rank").collect():
        got.setdefault(r.target_id, []).append((r.key, r.season))
    assert got == brute(rows, "euclidean", 3)


def test_wide_vectors_are_bounded_by_axes_and_the_length_of_the_rest(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 40)) + rng.normal(size=(300, 40)) * 0.2
    base[7] = base[8] = 0
    rows = [("c", f"k{i:03d}", i, [float(x) for x in v]) for i, v in enumerate(base)]
    frame = spark.createDataFrame(rows, "cohort string, key string, season int, vec array<double>").cache()
    targets = frame.select(F.col("season").alias("target_id"), "cohort", "key", "vec")
    for metric in METRICS:
        index = build_index(frame, 40, metric, None, 20)
        got = {}
        for r in nearest(targets, index, 4, 20).orderBy("target_id", "rank").collect():
            got.setdefault(r.target_id, []).append((r.key, r.season))
        assert got == brute(rows, metric, 4)
        asked = [(t[2], "c", t[1], t[3], o[1], o[2], score(t[3], o[3], metric)) for t in rows[::9] for o in [rows[(t[2] * 7 + 5) % 300]] if o[1] != t[1]]
        pairs = spark.createDataFrame(asked, "target_id int, cohort string, key string, vec array<double>, other_key string, other_season int, score double")
        ranks = {r.target_id: r["rank"] for r in rank_of(pairs, index, 20).collect()}
        by_id = {r[2]: r for r in rows}
        assert ranks == {a[0]: 1 + sum(order(r, by_id[a[0]], metric) < order(by_id[a[5]], by_id[a[0]], metric) for r in rows if r[1] != a[2]) for a in asked}


def test_fewer_rows_than_k(cloud):
    rows, frame, targets = cloud
    few = frame.filter("cohort = 'small'").limit(4)
    got = nearest(few.select(F.col("season").alias("target_id"), "cohort", "key", "vec"), build_index(few, 5, "euclidean", 51), 50)
    assert got.groupBy("target_id").count().filter("count > 3").isEmpty()


def test_a_crowded_vector_keeps_k_plus_one_keys(cloud):
    _, frame, _ = cloud
    kept = build_index(frame, 5, "euclidean", 4).rows.groupBy("cohort", "vec").agg(F.count_distinct("key").alias("keys"))
    assert kept.agg(F.max("keys")).first()[0] == 4


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("chunk_rows", [40, 4096])
def test_rank_of_equals_brute_force(spark, cloud, metric, chunk_rows):
    rows, frame, _ = cloud
    asked, expected = [], {}
    rng = np.random.default_rng(3)
    for t in rows[::5]:
        others = [r for r in rows if r[0] == t[0] and r[1] != t[1]]
        other = others[rng.integers(len(others))]
        asked.append((t[2], t[0], t[1], t[3], other[1], other[2], score(t[3], other[3], metric)))
        expected[t[2]] = 1 + sum(order(r, t, metric) < order(other, t, metric) for r in others)
    pairs = spark.createDataFrame(asked, "target_id int, cohort string, key string, vec array<double>, other_key string, other_season int, score double")
    got = {r.target_id: r["rank"] for r in rank_of(pairs, build_index(frame, 5, metric, None, chunk_rows), chunk_rows).collect()}
    assert got == expected


def canonical_rows(spark, n=60, constant=None):
    rng = np.random.default_rng(1)
    groups = ["FW", "MF", "DF_FW"]
    rows = []
    for i in range(n):
        values = [round(float(x), 4) for x in rng.gamma(2, 0.5, size=len(FEATURES))]
        if constant is not None:
            values[0] = constant
        rows.append((f"k{i:03d}", 2025, f"Name {i % 40}", "S", "L", "X", groups[i % 3], 1000, 1, True, *values))
    fields = ", ".join(f"{f} decimal(20,4)" for f in FEATURES)
    from decimal import Decimal

    rows = [(*r[:10], *[Decimal(str(v)) for v in r[10:]]) for r in rows]
    return spark.createDataFrame(
        rows, "canonical_player_key string, season int, player_name string, primary_squad_name string, primary_competition_name string, "
        f"position_raw string, position_group string, minutes long, stint_count long, is_similarity_eligible boolean, {fields}")


@pytest.fixture(scope="module")
def space(spark):
    return build_space(canonical_rows(spark))


def test_zscores_are_standard(space):
    rows = space.rows.collect()
    for group in {r.cohort for r in rows}:
        z = np.array([r.z for r in rows if r.cohort == group])
        assert np.allclose(z.mean(axis=0), 0, atol=1e-9) and np.allclose(z.std(axis=0), 1)


def test_constant_feature_has_zero_z(spark):
    flat = build_space(canonical_rows(spark, constant=0.5))
    assert {r.z[0] for r in flat.rows.collect()} == {0.0}
    pairs, _ = nth_neighbour(flat)
    share = explain_euclidean(pairs, flat).filter(F.col("feature") == FEATURES[0]).agg(F.max("distance_share_pct")).first()[0]
    assert share == 0


def test_missing_features_leave_the_cohort_out(spark):
    rows = canonical_rows(spark).withColumn(FEATURES[2], F.when(F.col("canonical_player_key") != "k000", F.col(FEATURES[2])))
    holed = build_space(rows)
    assert {r.cohort for r in holed.rows.select("cohort").distinct().collect()} == {"2025|MF", "2025|DF_FW"}
    wide = moments(rows).filter("position_group = 'FW'").first()
    assert wide[f"missing_{FEATURES[2]}"] == 1 and wide[f"missing_{FEATURES[0]}"] == 0


def test_pooled_cohorts(spark):
    pooled = build_space(canonical_rows(spark), cohort_cols=["position_group"])
    assert {r.cohort for r in pooled.rows.select("cohort").distinct().collect()} == {"FW", "MF", "DF_FW"}


def test_distance_is_symmetric_and_explained(space):
    pairs, outcomes = nth_neighbour(space, 1)
    rows = explain_euclidean(pairs, space).collect()
    assert len(rows) == 60 * len(FEATURES)
    totals = {}
    for r in rows:
        t = totals.setdefault(r.target_id, [0.0, 0.0, r.distance])
        t[0] += r.distance_share_pct
        t[1] += r.squared_contribution
    assert all(abs(share - 100) < 1e-6 and abs(math.sqrt(total) - d) < 1e-9 for share, total, d in totals.values())
    assert outcomes.filter("status = 'OK'").count() == 60


def test_identical_vectors_have_no_shares(spark):
    twins = canonical_rows(spark, 3).withColumn("position_group", F.lit("FW"))
    for f in FEATURES:
        twins = twins.withColumn(f, F.when(F.col("canonical_player_key") == "k002", F.lit(1)).otherwise(F.lit(2)).cast("decimal(20,4)"))
    flat = build_space(twins)
    pairs, _ = nth_neighbour(flat)
    row = explain_euclidean(pairs.filter("target_id = 'k000|2025'"), flat).agg(F.max("distance"), F.max("distance_share_pct")).first()
    assert tuple(row) == (0.0, 0.0)


def test_cosine_contributions_sum_to_the_score(space):
    pairs, _ = nth_neighbour(space, 2, "cosine")
    sums = explain_cosine(pairs, space).groupBy("target_id").agg(F.sum("cosine_contribution").alias("total"))
    assert sums.join(pairs, "target_id").filter(F.abs(F.col("total") - F.col("score")) > 1e-9).isEmpty()


def test_zero_vector_cannot_be_explained(spark):
    flat = canonical_rows(spark, 4).withColumn("position_group", F.lit("FW"))
    for f in FEATURES:
        flat = flat.withColumn(f, F.lit(1).cast("decimal(20,4)"))
    zero = build_space(flat)
    pairs, _ = nth_neighbour(zero, 1, "cosine")
    assert pairs.filter("score <> 0").isEmpty() and pairs.count() == 4
    rows = explain_cosine(pairs, zero)
    assert rows.filter("status <> 'ZERO_VECTOR' OR cosine_contribution IS NOT NULL").isEmpty()
    assert {r.direction for r in rows.select("direction").distinct().collect()} == {"opposite sides of avg"}


def test_rank_beyond_the_cohort(space):
    pairs, outcomes = nth_neighbour(space, 99)
    assert pairs.isEmpty() and {(r.status, r.available) for r in outcomes.collect()} == {("RANK_UNAVAILABLE", 19)}
    with pytest.raises(ValueError):
        nth_neighbour(space, 0)


def test_top_features(space):
    pairs, _ = nth_neighbour(space, 1)
    rows = explain_euclidean(pairs, space)
    top = top_features(rows, "squared_contribution")
    assert top.count() == 60 * 5
    low = {r.target_id: r.m for r in top.groupBy("target_id").agg(F.min("squared_contribution").alias("m")).collect()}
    kept = {(r.target_id, r.feature) for r in top.collect()}
    assert all(r.squared_contribution <= low[r.target_id] + 1e-6 for r in rows.collect() if (r.target_id, r.feature) not in kept)


def test_metric_comparison_and_candidates(space):
    rows = compare_metrics(space, k=19)
    assert rows.count() == 60 * 3 * 19
    ranks = {(r.target_id, r.metric, r.key): r["rank"] for r in rows.collect()}
    targets = all_targets(space).withColumn("candidate_name", F.lit(" name 3 "))
    found = candidate_ranks(find_candidates(targets, space), space).collect()
    assert len(found) == 60
    for r in found:
        if r.status == "OK":
            assert [r[f"{m}_rank"] for m in METRICS] == [ranks[r.target_id, m, r.other_key] for m in METRICS]
    missing = {r.target_id for r in found if r.status == "CANDIDATE_NOT_FOUND"}
    # "Name 3" is k003 (FW) and k043 (MF); nobody of the third group has it, and k003 may not name itself.
    groups = {r.key: r.position_group for r in space.rows.collect()}
    assert missing == {f"{k}|2025" for k, g in groups.items() if g == "DF_FW" or (g == "FW" and k == "k003") or (g == "MF" and k == "k043")}


def test_metrics_without_a_tree_are_one_pass(space):
    indexes = _indexes(space, 5, CHUNK_ROWS)
    assert _sharing(indexes) == [METRICS] and all(i.single for i in indexes.values())
    assert _sharing(_indexes(space, 5, 16, force_tree=True)) == [METRICS[:2], METRICS[2:]]


def test_a_cohort_of_one_part_needs_no_stored_tree(spark):
    rows = spark.range(CHUNK_ROWS + 500).select(
        F.lit("c").alias("cohort"), F.format_string("k%06d", "id").alias("key"), F.lit(1).alias("season"), F.array(F.col("id") * 1.0, F.lit(0.0)).alias("vec")
    )
    index = build_index(rows, 2)
    assert index.single and index.whole
    targets = rows.filter("key IN ('k000000', 'k009000')").withColumn("target_id", F.col("key"))
    assert {(r.target_id, r.key, r["rank"]) for r in nearest(targets, index, 2).collect()} == {
        ("k000000", "k000001", 1), ("k000000", "k000002", 2), ("k009000", "k008999", 1), ("k009000", "k009001", 2)}


def test_candidates_are_looked_up_by_asked_names_alone(space):
    """Two keys per asked name meet the targets once; rows of other names do not move."""
    found = find_candidates(all_targets(space).withColumn("candidate_name", F.lit("Name 3")), space)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join") == 1 and found.count() == 60


@pytest.mark.parametrize("metric", METRICS[:2])
def test_a_query_leaves_out_leaves_beyond_its_own_bound(metric):
    """Queries of one group that lie far apart do not search each other's leaves."""
    rng = np.random.default_rng(3)
    places = np.repeat(np.arange(8) * 1000.0, 1024)
    vectors = np.column_stack([places, np.zeros((len(places), 2))]) + rng.normal(size=(len(places), 3))
    frame = pd.DataFrame({"key": [f"k{i:05d}" for i in range(len(places))], "season": 1, "vec": list(vectors), "cell": 0})
    asked = frame.iloc[::512].reset_index(drop=True)
    block, looked = _Block(asked, frame, metric, np.zeros(len(asked))), []
    estimate = block.estimate
    block.estimate = lambda rows, start, stop: looked.append(len(rows) * (stop - start)) or estimate(rows, start, stop)
    one, none = np.ones(len(asked), np.int64), np.full(len(asked), np.nan)
    who, found, _, score = _nearest_of(block, np.arange(len(asked)), one, none, np.full(len(asked), None), metric)
    assert sum(looked) < len(asked) * len(frame) / 2
    for query, value in zip(who, score):
        gaps = np.abs(vectors - asked["vec"][query])
        away = np.sort(np.sqrt((gaps**2).sum(axis=1)) if metric == "euclidean" else gaps.sum(axis=1))
        assert value == pytest.approx(away[1])


def test_role_ranking_uses_only_the_role_features(space):
    rows = {(r.key): r for r in space.rows.collect()}
    for r in role_neighbours(space, k=3).collect():
        target = rows[r.target_id.split("|")[0]]
        chosen = [FEATURES.index(f) for f in ROLE_FEATURES[target.position_group]]
        assert r.score == pytest.approx(math.sqrt(sum((target.z[i] - rows[r.key].z[i]) ** 2 for i in chosen)))


def test_role_overlap(space):
    rows = role_experiment(space, n=5).collect()
    assert len(rows) == 60
    assert all((r.status == "NO_ROLE_FEATURES") == (r.overlap is None) for r in rows) and {r.status for r in rows} == {"OK", "NO_ROLE_FEATURES"}
    assert all(0 <= r.overlap <= 5 for r in rows if r.overlap is not None)


def test_missing_features_are_told_with_counts(spark):
    rows = canonical_rows(spark).withColumn(FEATURES[2], F.when(F.col("canonical_player_key") != "k000", F.col(FEATURES[2])))
    told = {r.position_group: (r.status, r.detail) for r in cohort_outcomes(build_space(rows)).collect()}
    assert told["FW"] == ("MISSING_FEATURES", f"Missing feature values detected: {FEATURES[2]}: 1")
    assert told["MF"] == ("OK", None)


def test_small_cohorts_are_told(spark):
    rows = canonical_rows(spark).filter("position_group <> 'MF' OR canonical_player_key < 'k005'")
    told = {r.position_group: (r.cohort_size, r.status) for r in cohort_outcomes(build_space(rows)).collect()}
    assert told["MF"] == (2, "COHORT_TOO_SMALL")


def test_an_entity_may_not_occur_twice_in_a_season(spark):
    rows = canonical_rows(spark)
    with pytest.raises(ValueError, match="k001 2025"):
        build_space(rows.unionByName(rows.filter("canonical_player_key = 'k001'")))


def test_cosine_total_is_the_sum_of_contributions(space):
    pairs, _ = nth_neighbour(space, 2, "cosine")
    rows = explain_cosine(pairs, space).groupBy("target_id").agg(F.sum("cosine_contribution").alias("parts"), F.max("similarity").alias("total"))
    scores = {r.target_id: r.score for r in pairs.collect()}
    assert all(r.parts == pytest.approx(r.total) == pytest.approx(scores[r.target_id]) for r in rows.collect())


def test_parts_give_the_same_and_ranks_narrow_the_lists(spark, cloud):
    """Cohorts of several parts, and of one; targets that ask for ranks get these and the last one, which counts the rest."""
    rows, frame, targets = cloud
    want = brute(rows, "euclidean", 7)
    split = build_index(frame, 5, "euclidean", 8, 40, part_rows=150)
    assert not split.whole and split.parts.filter("cohort = 'big'").count() > 2
    some = targets.filter("target_id % 5 = 0").withColumn("ranks", F.when(F.col("target_id") % 2 == 0, F.array(F.lit(2))))
    for index in (split, build_index(frame, 5, "euclidean", 8, 40)):
        got = {}
        for r in nearest(some, index, 7, 40).orderBy("target_id", "rank").collect():
            got.setdefault(r.target_id, []).append((r.key, r.season))
        assert got == {t: ([w[1], w[6]] if t % 2 == 0 else w) for t, w in want.items() if t % 5 == 0}
    asked = [(t[2], t[0], t[1], t[3], o[1], o[2], score(t[3], o[3], "euclidean"))
             for t in rows[::40] for o in [next(r for r in rows[t[2] % 97 :] if r[0] == t[0] and r[1] != t[1])]]
    pairs = spark.createDataFrame(asked, "target_id int, cohort string, key string, vec array<double>, other_key string, other_season int, score double")
    by_id = {r[2]: r for r in rows}
    expected = {a[0]: 1 + sum(order(r, by_id[a[0]], "euclidean") < order(by_id[a[5]], by_id[a[0]], "euclidean")
                              for r in rows if r[0] == a[1] and r[1] != a[2]) for a in asked}
    assert {r.target_id: r["rank"] for r in rank_of(pairs, build_index(frame, 5, "euclidean", None, 40, part_rows=150), 40).collect()} == expected


def test_rounds_of_a_search_leave_one_list_of_the_best(spark):
    import os

    from stintworks import workspace

    pick = np.random.default_rng(5)
    rows = spark.createDataFrame([("c", f"k{i:03d}", 2025, [float(x) for x in pick.normal(size=2)]) for i in range(120)], "cohort string, key string, season int, vec array<double>").cache()
    targets = rows.select(F.concat("key", F.lit("|t")).alias("target_id"), "cohort", "key", "vec")
    with workspace.scope(spark):
        index = build_index(rows, 2, keep_per_vector=4, chunk_rows=8, part_rows=16)
        assert not index.whole
        found = nearest(targets, index, 3)
        names = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in workspace._SCOPES[-1] if os.path.exists(p.removeprefix("file:"))]
        got = {(r.target_id, r.rank): r.key for r in found.collect()}
    assert names.count("best") == 1 and "candidates" not in names
    points = {r.key: np.array(r.vec) for r in rows.collect()}
    for key, at in points.items():
        near = sorted((round(float(np.linalg.norm(at - other)), 6), k) for k, other in points.items() if k != key)[:3]
        assert [got[f"{key}|t", n] for n in (1, 2, 3)] == [k for _, k in near]
