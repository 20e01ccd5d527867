"""The ordinal regression against a second fit, and its predictions against brute force."""

from __future__ import annotations

import numpy as np

from ledgersift.llm import quality
from tests.llm import brute


def _objective(theta, x, y):
    """Mean log likelihood less the ridge, and its gradient, for weights, first threshold and log gap; all rows at once."""
    w, start, gap = theta[:-2], theta[-2], theta[-1]
    cuts = np.array([-np.inf, start, start + np.exp(gap), np.inf])
    z = x @ w
    s = lambda v: 1 / (1 + np.exp(-v))
    up, low = s(z - cuts[y]), s(z - cuts[y + 1])
    p = up - low
    du, dl = up * (1 - up) / p, low * (1 - low) / p
    first, second = (dl * (y == 0) - du * (y == 1)).mean(), (dl * (y == 1) - du * (y == 2)).mean()
    gradient = np.r_[x.T @ (du - dl) / len(y) - quality.RIDGE * w, first + second, second * np.exp(gap)]
    return np.log(p).mean() - quality.RIDGE / 2 * (w @ w), gradient


def test_long_fit_reaches_the_optimum(monkeypatch):
    rng = np.random.default_rng(1)
    x = (rng.random((3000, 12)) < 0.4).astype(float)
    noise = rng.logistic(size=3000)
    z = x @ rng.normal(0, 1, 12) + noise
    y = np.digitize(z, [-0.5, 1.0])
    theta, rate = np.r_[np.zeros(12), -1.0, 0.0], 1.0
    value, slope = _objective(theta, x, y)
    for _ in range(3000):
        moved, turned = _objective(theta + rate * slope, x, y)
        if moved < value:
            rate /= 2
            continue
        theta, value, slope, rate = theta + rate * slope, moved, turned, rate * 1.1
    assert np.abs(slope).max() < 1e-3
    rows = [(int(g), np.flatnonzero(r)) for g, r in zip(y, x, strict=True)]
    at = lambda m: _objective(np.r_[m.weights[:12], m.thresholds[0], np.log(np.diff(m.thresholds)[0])], x, y)[0]
    short = quality.fit(rows)
    monkeypatch.setattr(quality, "EPOCHS", 300)
    long = quality.fit(rows)
    assert value - 0.002 < at(long) <= value and value - 0.02 < at(short)
    want = 1 / (1 + np.exp(-((x @ theta[:-2])[:, None] - np.array([theta[-2], theta[-2] + np.exp(theta[-1])]))))
    tails = np.array([long.tails(np.flatnonzero(r)) for r in x])
    assert np.abs(tails - want).max() < 0.05 and np.abs(tails - want).mean() < 0.02


def test_predictions_equal_brute_force(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = quality.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.limit(80).collect()} | {-1: None, -2: "", -3: "!!! A A a\n| | É é"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in quality.grade(frame, model).collect():
        tails = brute.quality(model, texts[r.doc_id])
        assert np.allclose([r.p_not_toxic, r.p_top, r.expected_grade], [tails[0], tails[-1], sum(tails)], atol=1e-4)
        assert r.selected == (r.p_top >= 0.5)


def test_training_is_bounded_under_repeated_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(3000)] + [(8, "one text")] * 3000, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int").filter("doc_id is not null")
    seen, real = [], quality.fit
    monkeypatch.setattr(quality, "is_held_out", lambda key: key.isNull())
    monkeypatch.setattr(quality, "fit", lambda rows: seen.append(len(rows)) or real(rows))
    quality.train(docs, labels, max_rows=200)
    assert 20 < seen[0] < 250
