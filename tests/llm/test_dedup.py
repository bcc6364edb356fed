import hashlib
from collections import defaultdict

import pytest

from stintworks.llm import dedup


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[lowered(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, hashlib.sha256(text.encode()).hexdigest()))
            first = first and i != keep
    return sorted(out, key=repr)


def answer(frame):
    return sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in frame.collect()), key=repr)


@pytest.mark.parametrize(
    "index", [{}, {"bucket_bytes": 500}, {"bucket_bytes": 50, "max_depth": 3}, {"hash_bits": 2}, {"hash_bits": 2, "digest_chars": 1}]
)
def test_like_brute_force_under_any_index(make_docs, edge_rows, index):
    """Small buckets split, few address bits chain, and cut digests clash; the answer stays."""
    assert answer(dedup.exact_dedup(make_docs(edge_rows), **index)) == brute(edge_rows)


def test_empty_table(make_docs):
    assert dedup.exact_dedup(make_docs([])).collect() == []
    assert dedup.keep_unique(make_docs([])).collect() == []


def test_hot_group(make_docs):
    rows = [(i, "Copy" if i % 3 else f"text {i}") for i in range(600)]
    assert answer(dedup.exact_dedup(make_docs(rows))) == brute(rows)


def test_keep_unique_keeps_columns_and_one_of_each(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    kept = dedup.keep_unique(docs)
    assert kept.columns == docs.columns
    assert sorted(lowered(r["text"]) for r in kept.collect()) == sorted({lowered(r[1]) for r in edge_rows})


def test_overfull_buckets_split_and_the_directory_doubles(spark):
    keys = spark.createDataFrame([(i * 2, 10) for i in range(64)], "address long, n_bytes long")  # even 7-bit addresses
    slots, depth = dedup.directory(keys, 7, 40, 20)
    loads = {}
    for r in keys.collect():
        slot = r["address"] >> (7 - depth)
        bucket = next(s["bucket"] for s in slots.collect() if s["slot"] == slot)
        loads[bucket] = loads.get(bucket, 0) + r["n_bytes"]
    assert max(loads.values()) <= 40 and len(loads) == 16


def test_a_single_key_does_not_split_for_ever(spark):
    keys = spark.createDataFrame([(5, 10_000)], "address long, n_bytes long")
    slots, depth = dedup.directory(keys, 6, 10, 20)
    assert depth <= 6 and slots.count() == 1


def test_partial_aggregation_comes_before_the_shuffle(spark, make_docs, edge_rows):
    """Copies shrink within a task: the grouping on texts is aggregated on both sides of its exchange."""
    rows = dedup.digests(make_docs(edge_rows), "doc_id", "text", 63, 64)
    plan = rows.groupBy("address", "norm").agg({"doc_id": "max"})._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan
