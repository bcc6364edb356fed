"""Runs: stretches of words that repeat with one period, at every scale of period.

A run is a stretch of at least ``max(6, 4 q)`` words with smallest period q that no neighbouring word
extends. Periods are searched by octave, P <= q < 2 P. Within a run of such a period some multiple b of P
lies so that the 2 P words at b come again q words later. Hashes of blocks of 2 P words, doubled from octave
to octave, find the pairs (b, q) that can be; at such a boundary b a Z-function to the right and one to the left
of it, over a window of a few P words, tell for all q of the octave at once how far words q apart agree.
A period whose root is a power of a shorter word is dropped there: its stretch has that shorter period.
What the boundaries see are fragments of runs; those of one period that share q words are one.

A document of ordinary length is one tile. A longer one is exploded into overlapping tiles, for each octave
(the short periods share one tiling) tiles as long as its periods need, dealt to tasks by hash. Their fragments
meet by document and period in a shuffle and are stitched. The work is O(n log n) for n words at worst.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stintworks.llm.common import text_of
from stintworks.workspace import materialize

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
# Texts with more characters are exploded into tiles.
LONG_CHARS = 1 << 18
# Tiles of the shortest periods: words in a tile, without what it shares with the next one.
TILE_WORDS = 1 << 15
# A tile of a longer octave has so many times its shortest period.
TILE_PERIODS = 32
# What neighbouring tiles share, in shortest periods of the octave: a stretch this long is found in both.
SHARED_PERIODS = 6
# Words a task remembers the number of.
_REMEMBERED = 1 << 18

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class WordNumbers(dict):
    """A number for each word; different words have different numbers."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > _REMEMBERED:
            self.clear()  # numbers only matter within one document
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def words_of(text: str) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+``."""
    return text.encode("utf-8", "replace").split()


def z_function(x: list[int]) -> list[int]:
    """Z[i]: how many items of ``x`` from i on equal its first ones; Z[0] is 0 here."""
    n = len(x)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def primitive_periods(z: list[int], shortest: int) -> list[int]:
    """Periods q of the octave whose 2 * ``shortest`` first words come again, and whose root is no power."""
    live = {q for q in range(shortest, min(2 * shortest, len(z))) if z[q] >= 2 * shortest}
    for d in range(1, shortest):
        if not live:
            break
        reach = z[d]
        if reach < d:
            continue
        # The first q words are a power of the first d words.
        live.difference_update([q for q in range(2 * d, 2 * shortest, d) if q in live and reach >= q - d])
    return sorted(live)


def boundary_fragments(words: np.ndarray, at: int, shortest: int) -> list[tuple[int, int, int]]:
    """(period, begin, end) of the stretches around the boundary before word ``at``, within its window."""
    end = min(len(words), at + 6 * shortest)
    z = z_function(words[at:end].tolist())
    periods = primitive_periods(z, shortest)
    if not periods:
        return []
    begin = max(0, at - 2 * shortest)
    back = words[begin:at][::-1].tolist()
    # The words before the boundary, backwards, against those before the boundary q words on.
    ahead = words[begin : at + 2 * shortest][::-1].tolist()
    zb = z_function(back + [-1] + ahead)
    shift = len(back) + 1 + len(ahead) - len(back)
    return [(q, at - zb[shift - q], at + q + z[q]) for q in periods]


def join_fragments(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Fragments of one period that share at least a period are one."""
    out: list[list[int]] = []
    for q, begin, end in sorted(found):
        if out and out[-1][0] == q and begin + q <= out[-1][2]:
            out[-1][2] = max(out[-1][2], end)
        else:
            out.append([q, begin, end])
    return [tuple(x) for x in out]


def tile_fragments(words: np.ndarray, octaves: range) -> list[tuple[int, int, int]]:
    """(period, begin, end) of all maximal stretches in a tile, periods 2**k to 2**(k+1) - 1 for k in ``octaves``.

    Complete for stretches of at least q + 3 * 2**k words.
    """
    n = len(words)
    found: list[tuple[int, int, int]] = []
    h = _mix(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for k in range(octaves.stop):
        shortest = 1 << k
        if n < 4 * shortest:
            break
        h = _mix(h[:-shortest] * np.uint64(0x9E3779B97F4A7C15) + h[shortest:])  # blocks of 2 * shortest
        if k not in octaves:
            continue
        # Row a, column j: the block at a * shortest against the one (shortest + j) words on.
        rows = -(-max(0, len(h) - shortest) // shortest)
        if rows < 1:
            break
        whole = (len(h) - shortest) // shortest
        hit = np.zeros(rows, bool)
        if whole:
            later = h[shortest : (whole + 1) * shortest].reshape(whole, shortest)
            hit[:whole] = (later == h[0 : whole * shortest : shortest, None]).any(axis=1)
        if whole < rows:
            hit[whole] = (h[(whole + 1) * shortest :] == h[whole * shortest]).any()
        spread = []
        for a in np.flatnonzero(hit).tolist():
            spread += boundary_fragments(words, a * shortest, shortest)
        found += join_fragments(spread)
    return found


def octaves_of(n: int) -> int:
    """Octaves that a document of n words can have: runs hold at least four periods."""
    return max(0, (n // LEAST_EXPONENT).bit_length())


def keep_runs(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the fragments that are runs, by start, then period."""
    return sorted((b, e - b, q) for q, b, e in found if e - b >= max(LEAST_LENGTH, LEAST_EXPONENT * q))


def collapse_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats: all of a run after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    gone = np.cumsum(change[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


_FOUND = pa.schema([
    ("n_words", pa.int64()),
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
    ("collapsed", pa.string()),
])


def _solved(ids: pa.Array, texts: list[str], per_text) -> pa.RecordBatch:
    counts, runs, kept = [], [], []
    for i, text in enumerate(texts):
        words = words_of(text)
        found = per_text(i, words)
        counts.append(len(words))
        runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
        kept.append(b" ".join(collapse_words(words, found)).decode("utf-8"))
    arrays = [pa.array(c, f.type) for c, f in zip((counts, runs, kept), _FOUND)]
    return pa.RecordBatch.from_arrays([ids, *arrays], names=["doc_id", *_FOUND.names])


_RESULT = f"doc_id long, n_words long, runs {RUNS}, collapsed string"


def solve_whole(rows: DataFrame) -> DataFrame:
    """Documents (``doc_id, text``) that are one tile each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers()

        def find(_, words):
            return keep_runs(tile_fragments(numbers.of(words), range(octaves_of(len(words)))))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield _solved(part.column(0), part.column(1).to_pylist(), find)

    return rows.mapInArrow(run, _RESULT)


def explode_tiles(texts: DataFrame, tile_words: int, tile_periods: int = TILE_PERIODS) -> DataFrame:
    """``key, low, high, start, words``: tiles of the texts (``key, text``) for octaves low to high - 1.

    Periods whose shared stretch is short against ``tile_words`` have one tiling; each longer octave its own.
    """
    shared_octaves = max(1, (tile_words // (tile_periods // 2)).bit_length())

    def tiles(n: int) -> Iterator[tuple[int, int, int, int]]:
        high = octaves_of(n)
        groups = [(0, min(high, shared_octaves), tile_words)]
        groups += [(k, k + 1, tile_periods << k) for k in range(shared_octaves, high)]
        for low, top, core in groups:
            step = 1 << (top - 1) if top else 1
            core = -(-core // step) * step  # boundaries are multiples of the shortest period in every tile
            for start in range(0, max(n, 1), core):
                yield low, top, start, min(n, start + core + SHARED_PERIODS * step)

    schema = pa.schema([("key", pa.string()), ("low", pa.int32()), ("high", pa.int32()), ("start", pa.int64()), ("words", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                words = WordNumbers().of(words_of(text.as_py()))
                for low, high, start, end in tiles(len(words)):
                    part = pa.ListArray.from_arrays(pa.array([0, end - start], pa.int32()), pa.array(words[start:end]))
                    row = [pa.array([key.as_py()]), pa.array([low], pa.int32()), pa.array([high], pa.int32()), pa.array([start]), part]
                    yield pa.RecordBatch.from_arrays(row, schema=schema)

    return texts.select("key", "text").mapInArrow(run, "key string, low int, high int, start long, words array<int>")


def solve_tiles(tiles: DataFrame) -> DataFrame:
    """``key, period, begin, end``: fragments of every tile, in words of the document."""
    schema = pa.schema([("key", pa.string()), ("period", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, low, high, start = (batch.column(c)[i].as_py() for c in range(4))
                words = batch.column(4)[i].values.to_numpy()
                found = [(key, q, start + b, start + e) for q, b, e in tile_fragments(words, range(low, high))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    return tiles.mapInArrow(run, "key string, period long, begin long, end long")


def stitch(fragments: DataFrame) -> DataFrame:
    """``key, start, length, period`` of the runs: fragments of a document and period that share a period are one."""
    order = W.partitionBy("key", "period").orderBy("begin", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("begin") + F.col("period") > reach), 1).otherwise(0)
    numbered = fragments.withColumn("opens", opens).withColumn("piece", F.sum("opens").over(order))
    joined = numbered.groupBy("key", "period", "piece").agg(F.min("begin").alias("start"), F.max("end").alias("stop"))
    length = F.col("stop") - F.col("start")
    joined = joined.select("key", "start", length.alias("length"), "period")
    return joined.filter(F.col("length") >= F.greatest(F.lit(LEAST_LENGTH), F.lit(LEAST_EXPONENT) * F.col("period")))


def collapse_long(rows: DataFrame) -> DataFrame:
    """Documents (``doc_id, text, runs``) whose runs are known already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                known = [(r["start"], r["length"], r["period"]) for r in part.column(2)[0].as_py() or []]
                yield _solved(part.column(0), part.column(1).to_pylist(), lambda _, words: known)

    return rows.mapInArrow(run, _RESULT)


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_chars: int = LONG_CHARS, tile_words: int = TILE_WORDS, tile_periods: int = TILE_PERIODS
) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every document: one row per input row.

    ``runs`` has ``start, length, period`` by start, then period, in words from 0; ``collapsed`` is the text with one
    period of every run left, words joined by a blank. NULL text counts as empty; a text without words has no
    runs and collapses to an empty text. NULL and repeated ids are ordinary; equal long texts are solved once. Extra
    columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    is_long = F.char_length("text") > long_chars
    short = solve_whole(rows.filter(~is_long))
    long = rows.filter(is_long).withColumn("key", F.sha2("text", 256))
    # Equal texts meet by digest, so a long text that many documents share is exploded once.
    tiles = explode_tiles(long.dropDuplicates(["key"]), tile_words, tile_periods)
    fragments = solve_tiles(tiles.repartition("key", "low", "start"))
    runs = stitch(fragments).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    runs = materialize(runs, "periodic-runs")
    solved = collapse_long(long.join(runs, "key", "left").select("doc_id", "text", "runs"))
    return short.unionByName(solved)


def longest(runs: Column) -> Column:
    """The run of greatest length; of equal ones that with the smallest start, then period. NULL without runs."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))
    return F.array_min(ranked)


def summarize(found: DataFrame) -> DataFrame:
    """Numbers and digests of the result of ``find_runs``."""
    best = longest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.n")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(-1000 * best.n) div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def plant_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text``: the documents, a tenth of them (by hash of the id) made periodic from some word on.

    With h the CRC-32 of the decimal id and g = h div 10, a document with h mod 10 = 0 repeats from word a = g mod n on
    its next 1 + (n - a) div (3 + g mod 8) words; its words are then joined by a blank. A NULL id plants nothing.
    """
    doc_id = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), text_of(text_col).alias("text"), F.crc32(doc_id.cast("string").cast("binary")).alias("h"))
    planted = F.expr(r"""
        transform(array(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)), w ->
          transform(array(named_struct('a', CAST(h DIV 10 % size(w) AS INT), 'n', size(w))), m ->
            transform(array(CAST(1 + (m.n - m.a) DIV (3 + h DIV 10 % 8) AS INT)), p ->
              concat_ws(' ', transform(w, (x, i) -> IF(i < m.a, x, w[m.a + (i - m.a) % p]))))[0])[0])[0]
    """)
    has_words = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & has_words, planted).otherwise(F.col("text")).alias("text"))
