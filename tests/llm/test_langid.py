import random
import zlib

import numpy as np
import pytest

from stintworks.llm import langid

SYLLABLES = {"en": ["the", "ing", "and", "wh"], "fr": ["eau", "ré", "ç", "oi"], "de": ["sch", "ung", "ß", "ü"]}


def labelled(n=240, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = list(SYLLABLES)[i % 3]
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(8, 200)))
        rows.append((i, text, lang, "a"))
    return rows


def test_held_out_accuracy(make_docs):
    rows = labelled()
    out = langid.identify(make_docs(rows)).collect()
    truth = {r[0]: r[2] for r in rows}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r["held_out"]]
    assert len(out) == len(rows) and held
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_label_source_and_id_do_not_matter(make_docs):
    rows = labelled(60)
    model = langid.fit(make_docs(rows))
    one = langid.predict(make_docs(rows), model).select("text", "lang_pred", "score").collect()
    other = langid.predict(make_docs([(9000 - i, t, "xx", None) for i, t, _, _ in rows]), model).select("text", "lang_pred", "score").collect()
    assert sorted(one) == sorted(other)


def test_held_out_and_unlabelled_rows_do_not_train(make_docs):
    rows = labelled(90)
    spoiled = [(i, "zzz qqq " * 50, "xx", "a") if zlib.crc32(str(i).encode()) % 5 == 0 else (i, t, lang, s) for i, t, lang, s in rows]
    spoiled += [(1000 + i, "unlabelled words", None, "a") for i in range(20)]
    assert langid.fit(make_docs(spoiled)).languages == ["de", "en", "fr"]
    a, b = langid.fit(make_docs(rows)), langid.fit(make_docs(spoiled))
    assert np.array_equal(a.out, b.out)


def test_windows_cover_every_run_of_bytes():
    for n in (0, 1, langid.WINDOW - 1, langid.WINDOW, langid.WINDOW + 1, 3 * langid.STEP + 7, 2000):
        text = bytes(np.random.default_rng(n).integers(1, 256, n, dtype=np.uint8))
        cut, size = langid.windows(text)
        assert cut.shape[1] == langid.WINDOW
        runs = {bytes(row[: max(0, s)][i : i + 4]) for row, s in zip(cut, size) for i in range(max(0, s - 3))}
        assert all(text[i : i + 4] in runs for i in range(n - 3))


def test_tables_equal_the_network():
    model = langid.train([(i, t, lang) for i, t, lang, _ in labelled(30)], epochs=2)
    x = np.random.default_rng(1).integers(0, 256, (5, langid.WINDOW), dtype=np.uint8)
    pooled = langid._responses(x, model.unit).max(axis=1)
    wanted = langid._softmax(np.maximum(pooled + model.bias, 0) @ model.out + model.out_bias)
    assert np.allclose(langid.Predictor(model).windows(x), wanted, atol=1e-4)


def test_edge_rows(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    out = langid.identify(docs).collect()
    assert len(out) == len(edge_rows)
    und = {r["doc_id"] for r in out if r["lang_pred"] == "und"}
    assert {50, 51, 52, 63} <= und and not {60, 70, 71} & und
    assert all(0 <= r["score"] <= 1 for r in out)
    assert langid.predict(docs, langid.fit(docs)).columns == [*docs.columns, "lang_pred", "score", "surest"]


@pytest.mark.parametrize("rows", [[], [(1, "text", None, "a"), (2, None, "en", "a")]])
def test_nothing_to_learn_from(make_docs, rows):
    assert [(r["lang_pred"], r["score"]) for r in langid.identify(make_docs(rows)).collect()] == [("und", 0.0)] * len(rows)


def test_one_id_with_all_labels_is_sampled_like_many(make_docs):
    texts = [(t, lang) for _, t, lang, _ in labelled(60)]
    same_id = [(7, f"{t} {n}", lang, "a") for n in range(30) for t, lang in texts]
    model = langid.fit(make_docs(same_id), documents=20)
    assert model is not None and model.languages == ["de", "en", "fr"]
    one_row = [(7, "one english text", "en", "a")] * 3000
    assert langid.fit(make_docs(one_row), documents=20).languages == ["en"]


def test_the_stage_keeps_texts_without_labels_and_mixed_texts(spark, make_docs):
    import corpus_pipeline

    clean = [(i, t, None, "a") for i, t, _, _ in labelled(10)]
    docs = make_docs([*clean, (100, None, None, "a"), (101, "123 .", None, "a")])
    kept = corpus_pipeline.language(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(r[0] for r in clean)
    rows = labelled(120)
    by_lang = {lang: t for _, t, lang, _ in rows}
    mixed = (5000, " ".join(text + " " + text for text in by_lang.values()), None, "a")
    kept = corpus_pipeline.language(spark, make_docs([*rows, mixed, (5001, "12 34", None, "a")]), "")
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} | {5000}
    assert kept.columns == docs.columns


def test_a_text_crosses_once_and_parts_do_not_hold_their_batch(make_docs, monkeypatch):
    rows = labelled(60)
    docs, model, seen = make_docs([(i, t + t, lang, s) for i, t, lang, s in rows * 50]), langid.train([(i, t, lang) for i, t, lang, _ in rows], epochs=1), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda frame, run, schema: seen.append((frame, run)))
    langid.predict(docs, model)
    frame, run = seen[0]
    assert [f.name for f in frame.schema if f.dataType.simpleString() == "string"] == [f.name for f in docs.schema if f.dataType.simpleString() == "string"]
    whole = frame.toArrow().combine_chunks().to_batches()[0]
    parts = list(run(iter([whole])))
    assert sum(p.num_rows for p in parts) == whole.num_rows == 3000
    assert max(p.get_total_buffer_size() for p in parts) < whole.get_total_buffer_size() / 3
