"""The registered queries over whole tables: against their SQL, and within the pipeline."""

import os
from collections import Counter, defaultdict

import pytest

from stintworks.llm import dedup, langid, mixing, neardup
from stintworks.llm.queries import ORACLE, QUERIES

duckdb = pytest.importorskip("duckdb")
SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    rows = frame.collect()
    if name not in ORACLE:
        assert rows and not [t for _, t in frame.dtypes if t == "void"]
        return
    expected = duck.execute(ORACLE[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(repr([r[c] for c in columns]) for r in rows) == sorted(repr(list(r)) for r in expected.fetchall())


def test_there_is_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline
    from test_neardup import brute as near_brute

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {}
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        before, frame = frame, stage(spark, frame, SF_DIR).cache()
        kept[name] = frame.collect()
        if name == "language":
            found = {r["doc_id"]: r for r in langid.predict(before, langid.fit(before)).collect()}
            good = sorted(i for i, r in found.items() if r["lang_pred"] != "und" and r["surest"] >= corpus_pipeline.LEAST_SCORE)
            assert sorted(r["doc_id"] for r in kept[name]) == good and len(good) >= 0.95 * len(found)
        if name == "exact_dedup":
            assert Counter(r["doc_id"] for r in kept[name]) == Counter(r["doc_id"] for r in dedup.exact_dedup(before).filter("kept").collect())
        if name == "near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert sorted(r["doc_id"] for r in kept[name]) == sorted(r[0] for r in near_brute(rows, neardup.SHINGLE, neardup.PERCENT) if r[3])
        if name == "mixture":
            want = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect() if r["copies"]}
            assert Counter(r["doc_id"] for r in kept[name]) == want
        if name != "packing":
            assert frame.columns == docs.columns
    bins = defaultdict(list)
    for r in kept["packing"]:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in parts) <= 2048 for parts in bins.values())
    assert Counter(r["doc_id"] for r in kept["packing"] if r["piece"] == 0) == Counter(r["doc_id"] for r in kept["mixture"])


def test_run_gives_the_last_stage(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF_DIR)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
