"""Document fingerprints: one-permutation MinHash, optimally densified, a few bits per bin.

Every word shingle is hashed once; its high bits choose a bin, and a bin keeps its smallest hash. An
empty bin copies a full one that a hash of (bin, attempt) chooses, the same for all documents. Stored are
the low ``BITS`` bits of every bin; two unequal bins agree in them by chance once in ``2 ** BITS``,
which the likeness corrects.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from stintworks.llm.common import text_of

SHINGLE = 5
BINS = 256
BITS = 4
# Ranges of ids that documents are dealt to; four of them share a task.
MOST_PARTS = 1 << 14
ROWS_PER_PART = 1024
# Word hashes a task remembers.
_REMEMBERED = 1 << 18

# Lower-cases A-Z and turns the characters between words into blanks, as bytes.
TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b"\t\n\x0b\x0c\r " else b for b in range(256))


class WordHashes(dict):
    """64-bit hash of each word, remembered while few enough."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every bit depends on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str, size: int, hashes: WordHashes) -> np.ndarray:
    """Hash of each run of ``size`` words (A-Z lower-cased); with fewer words, of all of them as one run."""
    words = text.encode("utf-8", "replace").translate(TABLE).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    run = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        run = mix(run * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
    return run


class Fingerprinter:
    def __init__(self, bins: int = BINS, bits: int = BITS, size: int = SHINGLE):
        if bins & (bins - 1) or 8 % bits:
            raise ValueError("bins must be a power of two and bits divide eight")
        self.bins, self.bits, self.size = bins, bits, size
        self.shift = np.uint64(64 - (bins.bit_length() - 1))
        self.words = WordHashes()
        order = np.random.default_rng(5)
        # Attempt k of bin j looks into donors[k, j].
        self.donors = order.integers(0, bins, (32 * bins, bins), dtype=np.int32)

    def bins_of(self, text: str) -> np.ndarray | None:
        h = shingle_hashes(text, self.size, self.words)
        if not len(h):
            return None
        h.sort()
        place = (h >> self.shift).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        full = np.zeros(self.bins, bool)
        value = np.zeros(self.bins, np.uint64)
        full[place[first]], value[place[first]] = True, h[first]
        empty = np.flatnonzero(~full)
        for attempt in self.donors:
            if not len(empty):
                break
            donor = attempt[empty]
            found = full[donor]
            value[empty[found]] = value[donor[found]]
            empty = empty[~found]
        value[empty] = value[place[first[0]]]
        return value

    def fingerprint(self, text: str) -> str:
        """Packed low bits of the bins in hex; empty for a text without words."""
        value = self.bins_of(text)
        if value is None:
            return ""
        low = (mix(value) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        per = 8 // self.bits
        packed = np.zeros(self.bins // per, np.uint8)
        for k in range(per):
            packed |= low[k::per] << (k * self.bits)
        return packed.tobytes().hex()

    def likeness(self, a: str, b: str) -> float:
        """Estimated resemblance, 0 to 1. Texts without words are alike, and unlike any other."""
        if not a or not b:
            return float(a == b)
        x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
        per, mask = 8 // self.bits, (1 << self.bits) - 1
        same = sum(int((((x ^ y) >> (k * self.bits)) & mask == 0).sum()) for k in range(per)) / self.bins
        chance = 2.0**-self.bits
        return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def in_order(docs: DataFrame, id_col: str, text_col: str, rows_per_part: int) -> tuple[DataFrame, int]:
    """Documents dealt to ranges of ids, each range closed by copies of the first document of the next
    (``closes`` is 1), the last by the first of all. Bounds and first ids come from the ids alone, and there are
    at most ``MOST_PARTS`` of them; texts move once.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    ids = rows.select("doc_id")
    parts = min(MOST_PARTS, max(1, -(-ids.filter("doc_id IS NOT NULL").count() // rows_per_part)))
    marks = [i / parts for i in range(1, parts)]
    found = ids.agg(F.percentile_approx("doc_id", marks, 4 * MOST_PARTS)).first()[0] if marks else None
    cuts = np.array(sorted(set(found or [])), np.int64)
    beyond = len(cuts) + 1  # NULL ids go last; a range starts at its bound

    def part_of(column: pa.Array) -> np.ndarray:
        known = column.fill_null(0).to_numpy(zero_copy_only=False)
        return np.where(column.is_null().to_numpy(zero_copy_only=False), beyond, np.searchsorted(cuts, known, side="right"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part_of(batch.column(0)), pa.int64())], names=["doc_id", "part"])

    firsts = {
        r["part"]: r["first"]
        for r in ids.mapInArrow(place, "doc_id long, part long").groupBy("part").agg(F.min("doc_id").alias("first")).collect()
    }
    present = sorted(firsts)
    closed_by: dict[int | None, list[int]] = {}
    for here, following in zip(present, present[1:] + present[:1]):
        closed_by.setdefault(firsts[following], []).append(here)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text", "part", "closes"]
        for batch in batches:
            own = pa.array(part_of(batch.column(0)), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, own, pa.array(np.zeros(batch.num_rows, np.int32))], names=names)
            copies = [(i, part) for i, doc in enumerate(batch.column(0).to_pylist()) for part in closed_by.get(doc, ())]
            if copies:
                at, to = (pa.array(c, pa.int64()) for c in zip(*copies))
                yield pa.RecordBatch.from_arrays([c.take(at) for c in batch.columns] + [to, pa.array(np.ones(len(at), np.int32))], names=names)

    return rows.mapInArrow(deal, "doc_id long, text string, part long, closes int"), max(1, len(present))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS, size: int = SHINGLE
) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every document: one row per input row; NULL text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(bins, bits, size)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([maker.fingerprint(t) for t in texts], pa.string())],
                names=["doc_id", "n_chars", "fingerprint"],
            )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def compare_with_edits(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS, size: int = SHINGLE, rows_per_part: int = ROWS_PER_PART
) -> DataFrame:
    """Fingerprints of every document and of its edit (last half from the next document), and likeness to
    the edit and to the next document. Next goes by id, NULL last, equal ids by text; after the last
    comes the first, so a lone document follows itself."""
    dealt, parts = in_order(docs, id_col, text_col, rows_per_part)
    sorted_rows = dealt.repartition(-(-parts // 4), "part").sortWithinPartitions("part", "closes", F.col("doc_id").asc_nulls_last(), "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(bins, bits, size)
        held = None  # (part, id, text, fingerprint) that waits for its next document
        for batch in batches:
            out = []
            ids, parts_, places = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for i in range(batch.num_rows):
                if places[i] and (held is None or held[0] != parts_[i]):
                    continue  # a further document with the closing id
                text = batch.column(1)[i].as_py()
                own = maker.fingerprint(text)
                if held is not None:
                    other = edited(held[2], text)
                    mark = maker.fingerprint(other)
                    out.append(
                        (held[1], len(held[2]), hashlib.sha256(other.encode("utf-8", "replace")).hexdigest(), held[3], mark,
                         maker.likeness(held[3], mark), maker.likeness(held[3], own))
                    )
                held = None if places[i] else (parts_[i], ids[i], text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return sorted_rows.mapInArrow(run, schema)
