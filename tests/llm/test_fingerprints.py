import hashlib
import random

import numpy as np
import pytest

from stintworks.llm import fingerprints as fp


def order(rows):
    return sorted(((r[0] is None, r[0] or 0, (r[1] or "").encode()), r) for r in rows)


def brute(rows):
    listed = [(r[0], r[1] or "") for _, r in order([(r[0], r[1]) for r in rows])]
    out = []
    for k, (doc_id, text) in enumerate(listed):
        following = listed[(k + 1) % len(listed)][1]
        half = len(text) // 2
        other = text[: len(text) - half] + following[:half]
        out.append((doc_id, len(text), hashlib.sha256(other.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows_per_part", [1, 3, 10, 1000])
def test_edits_like_brute_force_however_dealt(make_docs, edge_rows, rows_per_part):
    rows = [r for r in edge_rows if len(r[1] or "") < 5000]
    out = fp.compare_with_edits(make_docs(rows), rows_per_part=rows_per_part).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out), key=repr) == brute(rows)


def test_whole_edge_table(make_docs, edge_rows):
    out = fp.compare_with_edits(make_docs(edge_rows)).collect()
    assert len(out) == len(edge_rows) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    by_text = {}
    marks = {r["doc_id"]: r["fingerprint"] for r in out if r["doc_id"] is not None}
    for doc_id, text, *_ in edge_rows:
        if doc_id is not None:
            assert by_text.setdefault(text or "", marks[doc_id]) == marks[doc_id]


def test_lone_document_follows_itself_and_empty_table(make_docs):
    (row,) = fp.compare_with_edits(make_docs([(7, "a b c d e f g h")])).collect()
    assert row["near_next"] == 1.0 and row["n_chars"] == 15
    assert fp.compare_with_edits(make_docs([])).collect() == []
    assert fp.fingerprint_documents(make_docs([])).collect() == []


def test_likeness_estimates_resemblance():
    rng = random.Random(3)
    maker = fp.Fingerprinter()
    errors = []
    for _ in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 200, 900]))]
        other = list(words)
        for _ in range(rng.randrange(0, len(words) // 6 + 1)):
            other[rng.randrange(len(other))] = f"x{rng.randrange(5000)}"
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, other))
        x, y = maker.fingerprint(" ".join(words)), maker.fingerprint(" ".join(other))
        errors.append(maker.likeness(x, y) - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.09


def test_bins_hold_minima_and_empty_bins_copy_full_ones():
    maker = fp.Fingerprinter()
    text = "one two three four five six seven"
    h = fp.shingle_hashes(text, 5, fp.WordHashes())
    value = maker.bins_of(text)
    assert set(value.tolist()) == set(h.tolist()) and len(h) == 3
    for x in h:
        assert value[int(x >> maker.shift)] <= x
    assert maker.bins_of(" \n ") is None and maker.fingerprint("") == "" and maker.likeness("", "") == 1.0


def test_only_az_is_lowered():
    maker = fp.Fingerprinter()
    assert maker.fingerprint("ABC d") == maker.fingerprint("abc D") != maker.fingerprint("abc e")
    assert maker.fingerprint("É") != maker.fingerprint("é")
