"""Licence scan with a generalised suffix automaton over the words of licence templates.

The automaton accepts every run of words that occurs in some template. Streaming a document through it
gives, at each word, the longest run ending there that a template contains (matching statistics).
Long matches of one template that follow each other in both texts are chained into spans; the share of
the template that a chain covers is its score.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stintworks.llm.common import text_of

# Phrases that name a licence wherever their words stand consecutively.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

# Opening or notice texts of public licences.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"
        " you may obtain a copy of the license at http www apache org licenses license 2 0",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that"
        " the following conditions are met redistributions of source code must retain the above copyright notice"
        " this list of conditions and the following disclaimer",
    ],
    "cc-by": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
        " public license as published by the free software foundation either version 3 of the license or at your"
        " option any later version",
    ],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction",
    ],
    "mpl-2.0": [
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was"
        " not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    ],
    "reserved": ["all rights reserved"],
}
LEAST_MATCH = 3
LEAST_COVER = 0.6
# Words of a template that may differ between two matches of a chain, and words of the document.
MOST_GAP = 6

_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(
    b if b >= 0x80 or b in b"0123456789" + _LETTERS else b + 32 if b in _LETTERS.upper() else 32 for b in range(256)
)


def words(text: str) -> list[bytes]:
    """Runs of digits, letters a-z (after lower-casing A-Z) and characters beyond ASCII."""
    return text.encode("utf-8", "replace").translate(_TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences; a state is a set of runs with the same places."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.first: list[tuple[int, int]] = [(-1, -1)]  # one (sequence, end) where the runs occur
        ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word)
                while len(ends) < len(self.link):
                    ends.append(set())
                ends[last].add((number, place))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            ends[self.link[state]] |= ends[state]
        self.ends = [sorted(e) for e in ends]

    def _add(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.link) - 1

    def _split(self, state: int, target: int, word: int) -> int:
        clone = self._add(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # the run is known from an earlier sequence
            target = self.next[last][word]
            return target if self.length[target] == self.length[last] + 1 else self._split(last, target, word)
        new, state = self._add(self.length[last] + 1, 0, {}), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, target, word)
        return new

    def statistics(self, run: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest known run that ends at each word."""
        state, length = 0, 0
        for word in run:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield state, length


class Scanner:
    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str], least_match: int, least_cover: float, most_gap: int):
        self.least_match, self.least_cover, self.most_gap = least_match, least_cover, most_gap
        self.labels = [label for label, texts in templates.items() for _ in texts]
        listed = [words(text) for texts in templates.values() for text in texts]
        phrase_words = {label: words(text) for label, text in phrases.items()}
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws in [*listed, *phrase_words.values()] for w in ws))}
        self.lengths = [len(ws) for ws in listed]
        self.automaton = Automaton([[self.vocabulary[w] for w in ws] for ws in listed])
        self.phrases = {label: tuple(self.vocabulary[w] for w in ws) for label, ws in phrase_words.items()}
        self.heads: dict[int, list[tuple[str, tuple[int, ...]]]] = {}
        for label, ids in self.phrases.items():
            self.heads.setdefault(ids[0], []).append((label, ids))
        # Shorter stretches of known words hold neither a phrase nor a match.
        self.least_run = min([least_match, *map(len, self.phrases.values())])

    def runs(self, ids: list[int | None]) -> Iterator[tuple[int, list[int]]]:
        """(start, words) of the stretches of known words; only they can match."""
        start, run = 0, []
        for place, word in enumerate(ids):
            if word is None:
                if len(run) >= self.least_run:
                    yield start, run
                if run:
                    run = []
            else:
                if not run:
                    start = place
                run.append(word)
        if len(run) >= self.least_run:
            yield start, run

    def scan(self, text: str) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, float]]]:
        """Number of words, places of phrases as (label, start), spans as (label, start, end, cover)."""
        found = words(text)
        ids = list(map(self.vocabulary.get, found))
        places, matches = [], []
        for start, run in self.runs(ids):
            for i, word in enumerate(run):
                for label, phrase in self.heads.get(word, ()):
                    if tuple(run[i : i + len(phrase)]) == phrase:
                        places.append((label, start + i))
            stats = list(self.automaton.statistics(run))
            for i, (state, length) in enumerate(stats):
                longest = i + 1 == len(stats) or stats[i + 1][1] <= length  # no longer match goes on from here
                if longest and length >= self.least_match:
                    matches.append((start + i + 1 - length, length, state))
        return len(found), places, self.chain(matches)

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Per template, matches in order are joined while both texts move on by little; long enough chains stay."""
        open_chains: dict[int, list[int]] = {}
        closed: list[tuple[int, int, int, int]] = []

        def close(number: int) -> None:
            start, end, _, covered = open_chains.pop(number)
            closed.append((number, start, end, covered))

        for start, length, state in matches:
            for number, last in self.automaton.ends[state]:
                first = last - length + 1
                held = open_chains.get(number)
                if held:
                    gap, skipped = start - held[1], first - held[2]
                    overlap = max(0, -gap, -skipped)
                    if gap <= self.most_gap and 0 <= skipped + overlap <= self.most_gap and length > overlap:
                        held[1], held[2], held[3] = start + length, last + 1, held[3] + length - overlap
                        continue
                    if gap <= 0 and held[3] >= length:
                        continue  # the same words at another place of the template
                    close(number)
                open_chains[number] = [start, start + length, last + 1, length]
        for number in list(open_chains):
            close(number)
        spans = [
            (self.labels[n], s, e, min(1.0, covered / self.lengths[n]))
            for n, s, e, covered in closed
            if covered >= self.least_cover * self.lengths[n]
        ]
        return sorted(set(spans), key=lambda s: (s[1], -s[3], s[0], s[2]))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, list[str]] | None = None,
    phrases: dict[str, str] | None = None,
    least_match: int = LEAST_MATCH,
    least_cover: float = LEAST_COVER,
    most_gap: int = MOST_GAP,
) -> DataFrame:
    """``doc_id, n_words, places, spans``: phrase places and template spans of every document, in words from 0.

    ``places`` is an array of (label, start), ``spans`` of (label, start, end, cover). NULL text counts as
    empty; a document without findings has empty arrays. One row per input row; extra columns are not read.
    """
    options = (templates or TEMPLATES, phrases or PHRASES, least_match, least_cover, most_gap)
    place = pa.struct([("label", pa.string()), ("start", pa.int64())])
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(place)), ("spans", pa.list_(span))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*options)
        for batch in batches:
            counts, places, spans = [], [], []
            for text in batch.column(1):
                n, p, s = scanner.scan(text.as_py())
                counts.append(n)
                places.append([{"label": a, "start": b} for a, b in p])
                spans.append([{"label": a, "start": b, "end": c, "cover": d} for a, b, c, d in s])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(places, schema.field(2).type), pa.array(spans, schema.field(3).type)],
                schema=schema,
            )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    kinds = "doc_id long, n_words long, places array<struct<label string, start long>>, spans array<struct<label string, start long, end long, cover double>>"
    return rows.mapInArrow(scan, kinds)


def summarize(found: DataFrame) -> DataFrame:
    """Labels and places per document; ``score`` is the best cover, 1 where a phrase stands."""
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    every = F.array_sort(F.array_distinct(F.concat(F.col("places.label"), F.col("spans.label"))))
    phrase = F.when(F.size("places") > 0, 1.0).otherwise(0.0)
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.greatest(phrase, F.coalesce(F.array_max("spans.cover"), F.lit(0.0))).alias("score"),
    )
