import random
import re
from collections import Counter, defaultdict

import pytest

from stintworks.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def waterfill(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in stopped]
        if not open_:
            return {s: most * sizes[s] for s in names}
        level = (total - sum(most * sizes[s] for s in stopped)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > most * sizes[s] + 1e-9}
        if not over:
            return {s: most * sizes[s] if s in stopped else weight[s] * level for s in names}
        stopped |= over


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "tiny", None])
        if source == "tiny" and rng.random() < 0.9:
            source = "a"
        rows.append((i, " ".join(["w"] * int(rng.paretovariate(1.2) * 5)), "en", source))
    return rows


@pytest.mark.parametrize("block", [4, 64])
def test_targets_and_takes(make_docs, block):
    rows = corpus()
    out = mixing.mix(make_docs(rows), block=block).collect()
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len(WORD.findall(text))
    goal = waterfill(sizes)
    taken = Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        share = goal[r["source"]] / sizes[r["source"]]
        assert share - 1 < r["copies"] < share + 1
        taken[r["source"]] += r["taken"]
    for source, wanted in goal.items():
        largest = max(r["size"] for r in out if r["source"] == source)
        bound = max(20, 0.01 * wanted) if block == 64 else largest / 2 + 1  # a root block of four has little to make good with
        assert abs(taken[source] - wanted) <= bound, (source, taken[source], wanted)
    assert sorted(r["doc_id"] for r in out) == [r[0] for r in rows]


def test_reruns_agree_on_any_partitioning(make_docs):
    docs = make_docs(corpus(300))
    one, two = (sorted((r["doc_id"], r["copies"]) for r in mixing.mix(d).collect()) for d in (docs, docs.repartition(7)))
    assert one == two


def test_draws_keep_expectations(make_docs):
    """Over many seeds a document is taken about as often as its share says."""
    rows = [(i, "w " * (5 + i % 7), "en", "ab"[i % 2]) for i in range(40)]
    docs = make_docs(rows).cache()
    total, share = defaultdict(int), {}
    for seed in range(12):
        for r in mixing.mix(docs, block=8, seed=seed).collect():
            total[r["doc_id"] % 2] += r["copies"]
            share[r["doc_id"] % 2] = r["target"] / r["source_size"]
    for k in (0, 1):
        assert abs(total[k] / 240 - share[k]) < 0.05


def test_edge_rows(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    out = mixing.mix(docs).collect()
    assert len(out) == len(edge_rows)
    assert all(r["size"] == 0 for r in out if r["doc_id"] in (50, 51, 52))
    mixed = mixing.take_mix(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in out:
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +want


def test_no_rows_and_no_words(make_docs):
    assert mixing.mix(make_docs([])).collect() == []
    assert [r["taken"] for r in mixing.mix(make_docs([(1, None), (2, "")])).collect()] == [0, 0]


def test_a_source_stops_at_its_limit_and_the_rest_is_shared(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got == pytest.approx(waterfill({"a": 10, "b": 1000, "c": 1000})) and got["a"] == 30
