import random
import re

import pytest

from stintworks.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text):
    words = WORD.findall(lowered(text))
    places = [
        (label, i) for label, p in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()
    ]
    starts = [i for _, i in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in places}))


CASES = [
    "Licensed under CC BY 4.0.", "CC-BY cc by CC\nBY", "GNU General Public License, all rights reserved. All Rights Reserved",
    "generál public license", "ccby cc  by", "general public general public license", "cc cc by by", "", None, "été cc by日本",
]


def test_base_like_brute_force(make_docs, edge_rows):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(100 + i, r[1]) for i, r in enumerate(edge_rows)]
    out = {r["doc_id"]: r for r in licenses.summarize(licenses.scan_licenses(make_docs(rows))).collect()}
    assert len(out) == len(rows)
    for i, text in rows:
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(text), text
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_matching_statistics_like_brute_force():
    rng = random.Random(1)
    sequences = [[rng.randrange(4) for _ in range(rng.randint(1, 25))] for _ in range(6)]
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    machine = licenses.Automaton(sequences)
    for _ in range(60):
        text = [rng.randrange(5) for _ in range(40)]
        for end, (state, length) in enumerate(machine.statistics(text)):
            longest = next((n for n in range(end + 1, 0, -1) if tuple(text[end + 1 - n : end + 1]) in runs), 0)
            assert length == longest
            if length:
                run = text[end + 1 - length : end + 1]
                wanted = {(k, e) for k, s in enumerate(sequences) for e in range(length - 1, len(s)) if s[e + 1 - length : e + 1] == run}
                assert set(machine.ends[state]) == wanted


@pytest.mark.parametrize("label", sorted(licenses.TEMPLATES))
def test_templates_are_found_whole_and_with_a_change(make_docs, label):
    rng = random.Random(2)
    text = max(licenses.TEMPLATES[label], key=len)
    changed = text.split()
    if len(changed) > 12:
        changed[len(changed) // 2] = "changedword"
    rows = [(1, f"Some words before. {text.upper()}! and after"), (2, "x " * 50 + " ".join(changed)), (3, " ".join(rng.choice("abcdef") for _ in range(300)))]
    out = {r["doc_id"]: r for r in licenses.scan_licenses(make_docs(rows)).collect()}
    found = [s for s in out[1]["spans"] if s["label"] == label]
    assert any(s["start"] == 3 and s["end"] == 3 + len(text.split()) and s["cover"] == 1.0 for s in found)
    assert any(s["label"] == label and s["start"] == 50 for s in out[2]["spans"])
    assert out[3]["spans"] == []


def test_distant_parts_are_no_chain(make_docs):
    first, second = "licensed under the apache", "license version 2 0"
    rows = [(1, f"{first} {'word ' * 30} {second}"), (2, f"{first} word {second}")]
    out = {r["doc_id"]: r["labels"] for r in licenses.summarize(licenses.scan_licenses(make_docs(rows))).collect()}
    assert out[1] == "" and out[2] == "apache-2.0"


def test_empty_table(make_docs):
    assert licenses.summarize(licenses.scan_licenses(make_docs([]))).collect() == []


def test_phrases_of_one_word_are_found(make_docs):
    docs = make_docs([(1, "foo apache bar"), (2, "apache"), (3, "apach e"), (4, None)])
    found = licenses.summarize(licenses.scan_licenses(docs, phrases={"asf": "apache"})).collect()
    assert {r["doc_id"]: r["n_base"] for r in found} == {1: 1, 2: 1, 3: 0, 4: 0}
