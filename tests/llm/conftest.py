import random

import pytest

# Extra columns named like results and helpers of the operators; none of them may be read.
CLASHES = ["kept", "keep_id", "size", "copies", "node", "label", "piece", "offset", "spans", "norm", "address", "part", "closes", "target", "bucket", "tie"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with clashing extra columns."""

    def make(rows):
        filled = []
        for row in rows:
            doc_id, text, lang, source = (*row, None, "a")[:4] if len(row) == 2 else row
            filled.append((doc_id, text, lang, source, None, *["x"] * len(CLASHES)))
        return spark.createDataFrame(filled, SCHEMA)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and blank texts, repeated rows, ties, a very long text, other scripts."""
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "été", "straße", "日本", "delta", "x1"]
    rows = [(i, sentence(rng, rng.randint(1, 60), words), rng.choice(["en", "fr"]), rng.choice(["a", "b", "c"])) for i in range(40)]
    rows += [(100 + i, rows[i][1].upper(), "en", "a") for i in range(5)]
    rows += [rows[3], rows[3], (50, None, None, None), (51, "", "en", None), (52, " \n\t", "en", "b"), (None, "no id", "en", "a"), (None, None, None, None)]
    rows += [(60, "É é É", "fr", "c"), (61, "é é é", "fr", "c"), (62, "🙂 emoji 🙂", None, "a"), (63, "123 456", "en", "a")]
    rows += [(70, sentence(rng, 30000, words), "en", "a"), (71, "a" * 100000, "en", "b"), (72, rows[3][1], "en", "a")]
    return rows
