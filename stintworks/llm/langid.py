"""Language identification with a small convolutional network over bytes.

Filters of width two, three and four slide over the UTF-8 bytes of a window, the largest response of
each filter is kept, and a softmax layer names the language. Training runs in numpy on a bounded sample
of labelled texts. For prediction a whole text is cut into windows of fixed length that overlap by the
widest filter, so no run of bytes is lost; a filter is a table look-up per pair of bytes, and windows run
in batches. The document gets the mean of its windows, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from stintworks.llm.common import text_of

UNDETERMINED = "und"
WIDTHS = (2, 3, 4)
FILTERS = 12
WINDOW = 256
STEP = WINDOW - max(WIDTHS) + 1
# Bound of the training sample: documents per language, and windows of each.
SAMPLE_DOCUMENTS = 400
SAMPLE_WINDOWS = 4
EPOCHS = 12
_CHUNK = 1024
# Texts that are predicted and written at a time.
_ROWS = 500


@dataclass
class Model:
    """``unit[w][j]`` is the (256, filters) table of byte j of the filters of width w."""

    languages: list[str]
    unit: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def windows(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(windows, window length) bytes padded with zeros, and the bytes each holds."""
    n = max(1, -(-max(0, len(text) - WINDOW + STEP) // STEP))
    padded = np.zeros((n - 1) * STEP + WINDOW, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    cut = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]
    return cut, np.minimum(WINDOW, len(text) - np.arange(n) * STEP)


def _responses(x: np.ndarray, unit: dict[int, np.ndarray]) -> np.ndarray:
    """(windows, positions, all filters) for training batches."""
    last = x.shape[1] - max(WIDTHS) + 1
    return np.concatenate(
        [sum(unit[w][j][x[:, j : j + last]] for j in range(w)) for w in WIDTHS], axis=2
    )


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(texts: list[tuple[int, str, str]], epochs: int = EPOCHS, seed: int = 3) -> Model:
    """Fit on ``(id, text, language)``; the order of the list does not matter. Cross entropy, Adam."""
    languages = sorted({lang for _, _, lang in texts})
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _, text, lang in sorted(texts):
        cut, size = windows(text.encode("utf-8", "replace"))
        cut = cut[size >= min(32, size.max())]
        chosen = rng.choice(len(cut), min(SAMPLE_WINDOWS, len(cut)), replace=False)
        xs.extend(cut[chosen])
        ys.extend([languages.index(lang)] * len(chosen))
    x, y = np.array(xs), np.array(ys)
    share = np.bincount(y, minlength=len(languages)) / len(y)
    weight = (1 / np.maximum(share, 1e-9) / len(languages))[y]  # languages count alike
    wide = FILTERS * len(WIDTHS)
    unit = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    params = [*unit.values(), np.zeros(wide, np.float32), rng.normal(0, 0.2, (wide, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for batch in np.array_split(rng.permutation(len(x)), -(-len(x) // 64)):
            step += 1
            bx, by, bw = x[batch], y[batch], weight[batch]
            response = _responses(bx, unit)
            at = response.argmax(axis=1)
            pooled = np.take_along_axis(response, at[:, None], axis=1)[:, 0] + params[-3]
            hidden = np.maximum(pooled, 0)
            error = _softmax(hidden @ params[-2] + params[-1])
            error[np.arange(len(by)), by] -= 1
            error *= bw[:, None] / len(by)
            back = (error @ params[-2].T) * (pooled > 0)
            grads = []
            for k, w in enumerate(WIDTHS):
                grad, own = np.zeros_like(unit[w]), slice(k * FILTERS, (k + 1) * FILTERS)
                for j in range(w):
                    seen = np.take_along_axis(bx, at[:, own] + j, axis=1)
                    np.add.at(grad[j], (seen, np.arange(FILTERS)[None]), back[:, own])
                grads.append(grad)
            grads += [back.sum(0), hidden.T @ error, error.sum(0)]
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(languages, unit, params[-3], params[-2], params[-1])


class Predictor:
    """The model as two tables over byte pairs: one for bytes t, t+1 and one for bytes t+2, t+3."""

    def __init__(self, model: Model):
        self.model = model
        front, back = [], []
        for w in WIDTHS:
            u = model.unit[w]
            front.append((u[0][:, None] + u[1][None]).reshape(65536, -1))
            rest = np.zeros((256, 256, u.shape[2]), np.float32)
            for j in range(2, w):
                rest += u[j][:, None] if j == 2 else u[j][None]
            back.append(rest.reshape(65536, -1))
        self.front, self.back = np.concatenate(front, axis=1), np.concatenate(back, axis=1)

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities of each window; the running maximum keeps memory at one position."""
        out = []
        for at in range(0, len(x), _CHUNK):
            columns = np.ascontiguousarray(x[at : at + _CHUNK].T).astype(np.intp)
            pairs = columns[:-1] * 256 + columns[1:]
            best = np.full((pairs.shape[1], self.front.shape[1]), -np.inf, np.float32)
            a, b = np.empty_like(best), np.empty_like(best)
            for t in range(len(pairs) - 2):
                np.take(self.front, pairs[t], axis=0, out=a, mode="clip")
                np.take(self.back, pairs[t + 2], axis=0, out=b, mode="clip")
                np.add(a, b, out=a)
                np.maximum(best, a, out=best)
            hidden = np.maximum(best + self.model.bias, 0)
            out.append(_softmax(hidden @ self.model.out + self.model.out_bias))
        return np.concatenate(out)

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Class probabilities of whole texts, and the greatest of any window. Windows of many texts run
        together, some thousands at a time."""
        total = np.zeros((len(texts), len(self.model.languages)))
        surest = np.zeros(len(texts))
        held, owners, sizes, n = [], [], [], 0

        def flush() -> None:
            if held:
                weight = np.maximum(np.concatenate(sizes), 1)
                chance, owner = self.windows(np.concatenate(held)), np.repeat(owners, [len(h) for h in held])
                np.add.at(total, owner, chance * weight[:, None])
                np.maximum.at(surest, owner, chance.max(axis=1))
                held.clear(), owners.clear(), sizes.clear()

        for i, text in enumerate(texts):
            cut, size = windows(text)
            for at in range(0, len(cut), 8 * _CHUNK):  # a very long text in parts
                held.append(cut[at : at + 8 * _CHUNK])
                owners.append(i)
                sizes.append(size[at : at + 8 * _CHUNK])
                n += len(held[-1])
                if n >= 4 * _CHUNK:
                    flush()
                    n = 0
        flush()
        return total / total.sum(axis=1, keepdims=True), surest


def held_out(id_col: str) -> F.Column:
    """True for ids whose crc32 is divisible by five; they are never trained on."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), F.lit(5)) == 0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", documents: int = SAMPLE_DOCUMENTS) -> Model | None:
    """Train on at most ``documents`` texts per language, chosen by hash of id and text among all that are not
    held out and have a label and a letter. Rows that agree in both count once. None if there is none."""
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").alias("lang")
    ).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out("id"))
    # 62 bits, so that the bound on them below stays within a long.
    rows = rows.withColumn("place", F.shiftrightunsigned(F.xxhash64(F.lit(11), "id", "text"), 2))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("place").alias("n")).collect()}
    if not counts:
        return None
    # A few more than wanted pass by hash; the smallest hashes of them stay.
    bound = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 3.0 * documents / n) * (1 << 62)))])
    near = rows.filter(F.col("place") <= F.element_at(bound, F.col("lang")))
    # Long texts are known by windows anyway: a sample text has a bounded number of bytes from its middle.
    span = 8 * WINDOW
    middle = F.substring("text", F.greatest(F.lit(1), F.floor((F.char_length("text") - span) / 2) + 1).cast("int"), F.lit(span))
    near = near.select("id", middle.alias("text"), "lang", "place").dropDuplicates(["lang", "place"])
    first = F.row_number().over(W.partitionBy("lang").orderBy("place", "id", "text"))
    sample = near.withColumn("n", first).filter(F.col("n") <= documents).select("id", "text", "lang")
    texts = [(r["id"] or 0, r["text"], r["lang"]) for r in sample.collect()]
    return train(texts) if texts else None


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``surest`` to every row; other columns pass, an input column of that name is replaced.

    The prediction uses the text alone; ``surest`` is the greatest probability of any window, however mixed the text.
    Without text, letter or model it is ``und`` with scores 0.
    """
    added = ["lang_pred", "score", "surest"]
    docs = docs.drop(*added)
    names = docs.columns
    kinds = (T.StringType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(added, kinds)]])
    # The text crosses to Python once: which rows to read is a flag beside it.
    ready = docs.withColumn("__known", F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False)))
    place = names.index(text_col)

    def labelled(batch: pa.RecordBatch, predictor: Predictor | None) -> pa.RecordBatch:
        texts = batch.column(place)
        known = [i for i, k in enumerate(batch.column(len(names)).to_pylist()) if k] if predictor else []
        langs, scores, peaks = [UNDETERMINED] * batch.num_rows, [0.0] * batch.num_rows, [0.0] * batch.num_rows
        if known:
            chance, surest = predictor.texts([texts[i].as_py().encode("utf-8", "replace") for i in known])
            for i, row, peak in zip(known, chance, surest):
                best = int(row.argmax())
                langs[i], scores[i], peaks[i] = model.languages[best], float(min(1.0, row[best])), float(min(1.0, peak))
        # Copied, so that a part that is still to be written does not hold the whole batch beside the next one.
        kept = batch.take(pa.array(range(batch.num_rows)))
        return pa.RecordBatch.from_arrays(
            [*kept.columns[: len(names)], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(peaks, pa.float64())],
            names=[*names, *added],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(model) if model else None
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                yield labelled(whole.slice(at, _ROWS), predictor)
            del whole

    return ready.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document. An empty table gives an empty result."""
    model = fit(docs, id_col, text_col, lang_col)
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    return predict(rows, model).drop("text", "surest")
