import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintworks.llm import neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows, size, percent):
    sets = [shingles(r[1], size) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        low.setdefault(root(i), []).append(r[0])
    out = []
    for i, r in enumerate(rows):
        component = min((x for x in low[root(i)] if x is not None), default=None)
        out.append((r[0], len(sets[i]), component, r[0] == component))
    return sorted(out, key=repr)


def answer(frame):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in frame.collect()), key=repr)


def near_copies(n=160, seed=5):
    """Groups around the threshold, chains of small steps, exact copies and loners."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    while len(rows) < n:
        words = [rng.choice(vocabulary) for _ in range(rng.choice([20, 60, 150]))]
        chain = list(words)
        for k in range(rng.choice([1, 1, 4, 9])):
            rows.append((rng.randrange(10**6), " ".join(chain if k else words)))
            source = chain if rng.random() < 0.5 else list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 25)):
                source[rng.randrange(len(source))] = rng.choice(vocabulary)
            chain = source
    return rows


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_like_brute_force(make_docs, size, percent):
    rows = near_copies()
    assert answer(neardup.near_duplicates(make_docs(rows), size=size, percent=percent)) == brute(rows, size, percent)


def test_edge_rows(make_docs, edge_rows):
    assert answer(neardup.near_duplicates(make_docs(edge_rows), size=3, percent=85)) == brute(edge_rows, 3, 85)


def test_empty_table(make_docs):
    assert neardup.near_duplicates(make_docs([])).collect() == []
    assert neardup.near_duplicates(make_docs([(1, None), (2, "")])).count() == 2


def test_a_crowded_bucket_of_unlinked_groups(make_docs, monkeypatch):
    """Groups below the threshold of each other share buckets; blocks of four rows find what stars do not."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(70):
        words = list(base)
        for at in rng.sample(range(0, 80, 9), rng.choice([1, 2, 3])):
            words[at] = f"v{rng.randrange(4)}"
        rows.append((i, " ".join(words)))
    out = neardup.near_duplicates(make_docs(rows), size=3, percent=85)
    assert answer(out) == brute(rows, 3, 85)


def test_chains_reach_the_smallest_id(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("500", f"{i}") for i in range(501, 560)]
    links = spark.createDataFrame(edges, "a string, b string").select(F.col("a").cast("binary"), F.col("b").cast("binary"))
    labels = {bytes(r["node"]): bytes(r["label"]) for r in neardup.components(links).collect()}
    assert {labels[f"{i:03d}".encode()] for i in range(1, 61)} == {b"000"} and {labels[f"{i}".encode()] for i in range(501, 560)} == {b"500"}


def test_keep_one(make_docs):
    rows = near_copies(60)
    docs = make_docs(rows)
    kept = neardup.keep_one(docs, size=5, percent=80)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in brute(rows, 5, 80) if r[3])


def standing(rows, size, percent):
    """(id, text) of the one row that stays of each component, and of all rows without words."""
    sets = [shingles(r[1], size) for r in rows]
    left, out = {i for i in range(len(rows)) if sets[i]}, [rows[i][:2] for i in range(len(rows)) if not sets[i]]
    while left:
        group, reach = [], [left.pop()]
        while reach:
            i = reach.pop()
            group.append(rows[i][:2])
            near = {j for j in left if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
            left -= near
            reach.extend(near)
        out.append(min(group, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).digest())))
    return sorted(out, key=repr)


def kept_rows(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=repr)


def test_keep_one_of_edge_rows(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    kept = neardup.keep_one(docs, size=3, percent=85)
    assert kept.columns == docs.columns
    assert kept_rows(kept) == standing(edge_rows, 3, 85)


def test_keep_one_where_ids_are_null_or_repeated(make_docs):
    """Each component keeps one row, whatever its ids are; other rows with the same id are not touched."""
    rng = random.Random(2)
    text = {c: " ".join(f"{c}{rng.randrange(10**6)}" for _ in range(60)) for c in "abcdefg"}
    near = {c: f"{t} more" for c, t in text.items()}
    rows = [(1, text["a"]), (None, near["a"]), (None, text["b"]), (None, text["c"]), (None, near["c"]), (None, text["c"].upper())]
    rows += [(5, text["d"]), (5, near["e"]), (4, text["e"]), (6, near["d"]), (7, text["f"]), (7, near["f"]), (8, text["g"]), (8, text["g"]), (None, None), (9, " ")]
    out = kept_rows(neardup.keep_one(make_docs(rows)))
    assert out == standing(rows, neardup.SHINGLE, neardup.PERCENT)
    assert len(out) == 9 and (None, text["b"]) in out and (5, text["d"]) in out


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_pruning_keeps_the_miss_probability(percent):
    """Pairs at the threshold survive all batches; far pairs go in the first ones."""
    rng = np.random.default_rng(0)
    hashes = neardup.bands_for(percent) * neardup.ROWS
    a = rng.integers(0, 2**32, (20000, hashes), dtype=np.uint32)
    same = rng.random(a.shape) < percent / 100
    assert neardup.survives(a, np.where(same, a, a + np.uint32(1)), percent, neardup.MISS).mean() > 0.9999
    far = rng.random(a.shape) < 0.3
    assert not neardup.survives(a, np.where(far, a, a + np.uint32(1)), percent, neardup.MISS).any()


def test_bands_reach_the_threshold():
    for percent in (80, 85):
        assert (1 - (percent / 100) ** neardup.ROWS) ** neardup.bands_for(percent) <= neardup.MISS
