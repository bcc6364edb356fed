import random
import zlib
from collections import Counter, defaultdict

import pytest

from stintworks.llm import sharding
from stintworks.workspace import new_path


def slow_differencing(weights, parts):
    """The rule as stated, on explicit sets."""
    states = [([(w, [i])] + [(0, []) for _ in range(parts - 1)], i) for i, w in enumerate(weights)]
    while len(states) > 1:
        states.sort(key=lambda s: (-(s[0][0][0] - s[0][-1][0]), s[1]))
        (a, i), (b, j), *rest = states
        both = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, b[::-1])]
        both = sorted(both, key=lambda x: -x[0])
        states = rest + [(both, min(i, j))]
    return [[w for w, _ in states[0][0]], {i: k for k, (_, members) in enumerate(states[0][0]) for i in members}]


@pytest.mark.parametrize("parts", [2, 3, 16])
def test_differencing_is_the_stated_rule(parts):
    rng = random.Random(parts)
    for n in [1, 2, 3, 17, 60]:
        for most in [1, 4, 1000]:
            weights = sorted((rng.randint(1, most) for _ in range(n)), reverse=True)
            found = sharding.differencing(weights, parts)
            sums, where = slow_differencing(weights, parts)
            assert found == [where[i] for i in range(n)]
            mine = Counter()
            for w, p in zip(weights, found):
                mine[p] += w
            assert [mine[p] for p in range(parts)] == sums
    assert sharding.differencing([], parts) == []


def test_differencing_is_tighter_than_longest_first():
    rng = random.Random(1)
    weights = sorted((rng.randint(1, 10**6) for _ in range(2000)), reverse=True)
    loads = [0] * 16
    for w in weights:
        loads[loads.index(min(loads))] += w
    mine = Counter()
    for w, p in zip(weights, sharding.differencing(weights, 16)):
        mine[p] += w
    assert max(mine.values()) - min(mine.values()) <= max(loads) - min(loads)


def check(rows, out, shards=16):
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    slots, homes = defaultdict(list), defaultdict(set)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        homes[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(0 <= s < shards and sorted(n) == list(range(len(n))) for s, n in slots.items())
    assert all(len(h) == 1 for h in homes.values())


@pytest.mark.parametrize("items", [1, 8, sharding.ITEMS])
def test_edge_table(make_docs, edge_rows, items):
    out = sharding.assign(make_docs(edge_rows), items=items).collect()
    check(edge_rows, out)
    assert sharding.assign(make_docs([])).collect() == []


def test_sizes_are_near_equal_and_a_hot_group_is_alone(make_docs):
    rng = random.Random(7)
    rows = [(i, "x" * rng.randint(0, 900)) for i in range(3000)]
    out = sharding.assign(make_docs(rows)).collect()
    check(rows, out)
    loads = Counter()
    for r in out:
        loads[r["shard"]] += r["size"]
    # Texts of one length are equal here, so groups are large: the spread stays below the largest group.
    groups = Counter()
    for r in out:
        groups[r["text_crc32"]] += r["size"]
    assert max(loads.values()) - min(loads.values()) < max(groups.values())
    hot = [(10000 + i, "hot text " * 20) for i in range(3000)]
    out = sharding.assign(make_docs(rows + hot)).collect()
    check(rows + hot, out)
    loads, hot_size = Counter(), 181 * 3000
    for r in out:
        loads[r["shard"]] += r["size"]
    others = sorted(loads.values())[:-1]
    if hot_size > sum(loads.values()) / 16:
        assert max(loads.values()) == hot_size and max(others) - min(others) < max(groups.values())


def test_bundles_balance_many_light_groups(make_docs):
    rng = random.Random(3)
    rows = [(i, f"{i} " * rng.randint(1, 40)) for i in range(4000)]
    out = sharding.assign(make_docs(rows), items=256).collect()
    check(rows, out)
    loads = Counter()
    for r in out:
        loads[r["shard"]] += r["size"]
    assert len(loads) == 16 and max(loads.values()) - min(loads.values()) < 0.01 * sum(loads.values()) / 16


def test_written_shards_hold_every_row_once(spark, make_docs, edge_rows):
    docs = make_docs(edge_rows)
    path = new_path(spark, "shards")
    sharding.write_shards(docs, path)
    back = spark.read.parquet(path)
    assert sorted(map(repr, back.select(docs.columns).collect())) == sorted(map(repr, docs.collect()))
    by_text = {(r["text"] or ""): r["__shard"] for r in back.collect()}
    assert all(by_text[r["text"] or ""] == r["__shard"] for r in back.collect())
