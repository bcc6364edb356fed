import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from stintworks.llm import periodic


def brute_runs(words):
    """Runs by the definition, period by period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_plant(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def split(text):
    return [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]


def brute_row(doc_id, text):
    words = brute_plant(doc_id, split(text))
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    numbers = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *numbers, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def periodic_words(rng, n, alphabet):
    out = []
    while len(out) < n:
        if rng.random() < 0.5:
            root = [rng.randrange(alphabet) for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 30]))]
            out += (root * 12)[: rng.randint(1, 10 * len(root) + 3)]
        else:
            out += [rng.randrange(alphabet) for _ in range(rng.randint(1, 9))]
    return out[:n]


def test_z_function():
    rng = random.Random(2)
    for _ in range(100):
        x = [rng.randrange(2) for _ in range(rng.randint(0, 30))]
        want = [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) if i else 0 for i in range(len(x))]
        assert periodic.z_function(x) == want


@pytest.mark.parametrize("alphabet", [1, 2, 3, 50])
def test_one_tile_against_definition(alphabet):
    rng = random.Random(alphabet)
    for trial in range(250):
        words = periodic_words(rng, rng.randint(0, 260), alphabet)
        found = periodic.tile_fragments(np.array(words, np.int32), range(periodic.octaves_of(len(words))))
        assert periodic.keep_runs(found) == brute_runs(words)


def rows_of(rng, count=120):
    rows = [(i, " ".join(f"w{x}" for x in periodic_words(rng, rng.randint(0, 300), rng.choice([1, 2, 3, 40])))) for i in range(count)]
    return rows + [(None, "a " * 50), (None, None), (3, None), (4, ""), (5, " \n\t"), (5, " \n\t"), (10**9, "é é é é é é é 日 日\n日\t日 日 日")]


def comparable(frame):
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"long_chars": 0, "tile_words": 64, "tile_periods": 8}, {"long_chars": 200, "tile_words": 32, "tile_periods": 8}])
def test_query_against_definition_however_tiled(make_docs, sizes):
    rows = rows_of(random.Random(5))
    found = periodic.find_runs(periodic.plant_runs(make_docs(rows)), **sizes)
    assert comparable(periodic.summarize(found)) == sorted((brute_row(*r) for r in rows), key=repr)


def test_edge_table_and_empty_table(make_docs, edge_rows):
    rows = [r for r in edge_rows if len(r[1] or "") < 5000]
    found = periodic.find_runs(periodic.plant_runs(make_docs(rows)))
    assert comparable(periodic.summarize(found)) == sorted((brute_row(r[0], r[1]) for r in rows), key=repr)
    whole = periodic.find_runs(make_docs(edge_rows)).collect()
    assert Counter(r["doc_id"] for r in whole) == Counter(r[0] for r in edge_rows)
    assert periodic.find_runs(make_docs([])).collect() == []


def test_very_long_texts_are_tiled_and_solved_once(make_docs):
    rng = random.Random(9)
    root = [f"r{rng.randrange(10**6)}" for _ in range(9000)]
    words = [f"a{rng.randrange(10**6)}" for _ in range(20000)] + root * 5 + ["x"] * 40000 + ["y z"] * 3 + [f"b{i}" for i in range(999)]
    text = " ".join(words)
    out = periodic.find_runs(make_docs([(1, text), (2, text), (None, text), (3, "short")])).collect()
    assert len(out) == 4
    for r in out:
        if r["n_words"] > 1:
            found = [(x["start"], x["length"], x["period"]) for x in r["runs"]]
            assert found == [(20000, 45000, 9000), (65000, 40000, 1)]
            assert len(r["collapsed"].split()) == len(text.split()) - 36000 - 39999
