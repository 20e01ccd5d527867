"""Every language that occurs is learned."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ledgersift.llm import langid
from tests.llm import brute


def test_rare_languages_are_learned(spark):
    rng = np.random.default_rng(2)
    words = {f"l{i:03}": ["".join(map(chr, rng.integers(97, 123, 5))) for _ in range(6)] for i in range(210)}
    rows, at = [], 0
    for i, (lang, vocab) in enumerate(words.items()):
        for _ in range(30 if i < 200 else 25):  # the last ten are the least frequent
            rows.append((at, " ".join(rng.choice(vocab, 12)), lang))
            at += 1
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(frame)
    assert model.languages == sorted(words)
    assert model.table.shape[1] == langid.DIMENSION and model.layer.shape[1] == len(words)
    few = langid.train(frame, max_rows=1050)
    assert len(few.languages) >= 200


def test_layer_and_table_agree():
    rows = [(f"l{i % 20:02}", *langid.counts(f"w{i % 20}rd th{i % 20}ng st{i % 20}ff")) for i in range(200)]
    model = langid.fit(rows)
    table = langid.LanguageModel(model.languages, model.table @ model.layer, model.bias, model.temperature, model.reject_below)
    texts = pa.array(["w3rd th3ng", "st7ff " * 500_000, "", None])
    one, other = model.predict(texts), table.predict(texts)
    assert (one[0] == other[0]).all() and np.allclose(one[1], other[1])


def test_training_is_bounded_under_repeated_ids(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["la", "le", "un", "das", "ein"], 4)) + f" {i}" for i in range(4000)]
    frame = spark.createDataFrame([(7 if i % 4 else i, t, "xy"[i % 2]) for i, t in enumerate(texts)] + [(8, "immer der gleiche satz", "x")] * 4000, "doc_id long, text string, lang string")
    seen = []
    real = langid.fit
    langid.fit = lambda rows: seen.append(len(rows)) or real(rows)
    try:
        langid.train(frame, per_language=100)
        langid.train(frame, max_rows=60)
    finally:
        langid.fit = real
    assert 20 < seen[0] < 260 and seen[1] < 100


def test_rejection_is_set_by_accuracy():
    scores = np.array([0.9, 0.8, 0.7, 0.45, 0.45, 0.3, 0.2])
    right = np.array([1, 1, 1, 1, 0, 1, 1], bool)
    assert langid.rejection(scores, right, 0.99) == 0.5
    assert langid.rejection(scores, right, 0.8) == 0.0
    assert langid.rejection(np.r_[scores, 0.1, 0.1], np.r_[right, False, False], 0.85) == 0.2
    assert langid.rejection(scores, np.zeros(7, bool), 0.5) == 0.5


def test_predictions_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs)
    rows = langid.predict(docs.limit(60).unionByName(docs.limit(1).selectExpr("doc_id", "'Ü\t1 ab' AS text", "lang", "source", "n_chars")), model).collect()
    for r in rows:
        lang, score = brute.language(model, r.text)
        assert r.language.lang == lang and abs(r.language.score - score) < 1e-6
        assert r.language.rejected == (lang == "und" or score < model.reject_below)
