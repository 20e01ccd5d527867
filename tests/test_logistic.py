"""The fitted models on data whose answer is known."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from ledgersift.config import LogisticSpec, TreeSpec
from ledgersift.operators import scoring


def _matrix(spark, n=400):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        x = rng.random() * 10
        rows.append((i, *[x if c == "in_degree" else (None if c == "pass_through_ratio" and i % 3 == 0 else rng.random()) for c in scoring.FEATURES], int(rng.random() < 1 / (1 + math.exp(4 - x)) * 0.6)))
    columns = ", ".join(f"{c} double" for c in scoring.FEATURES)
    return spark.createDataFrame(rows, f"account long, {columns}, is_mule int").withColumn("window", F.lit("train"))


def _newton(x, y, penalty):
    """Balanced, L2-penalised logistic regression by Newton's method."""
    n, p = len(y), y.sum()
    w = np.where(y == 1, n / (2 * p), n / (2 * (n - p)))
    design, beta = np.c_[x, np.ones(n)], np.zeros(x.shape[1] + 1)
    ridge = np.diag([penalty] * x.shape[1] + [0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-design @ beta))
        beta -= np.linalg.solve((design * (w * q * (1 - q))[:, None]).T @ design + ridge, design.T @ (w * (q - y)) + ridge @ beta)
    return 1 / (1 + np.exp(-design @ beta))


def test_logistic_equals_newton(spark):
    m = _matrix(spark)
    spec = LogisticSpec(log1p_features=("in_degree", "pass_through_ratio"))
    got = {r.account: r.logistic for r in scoring.fit_logistic(m, spec).score(m).collect()}
    rows = sorted(m.collect(), key=lambda r: r.account)
    x = np.array([[np.nan if r[c] is None else math.log1p(r[c]) if c in spec.log1p_features else r[c] for c in scoring.FEATURES] for r in rows], float)
    x = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    want = _newton(x, np.array([r.is_mule for r in rows], float), 1.0)
    assert np.allclose([got[r.account] for r in rows], want, atol=2e-4)


def test_trees_keep_the_best_prefix(spark):
    m = _matrix(spark)
    trees = scoring.fit_trees(m, m, TreeSpec(max_depth=3, early_stopping_rounds=5), rounds=6)
    assert 1 <= trees.kept <= 6 and trees.importance()[0][0] == "in_degree"
    scored = trees.score(m)
    assert scored.filter("xgboost > 0 and xgboost < 1").count() == 400
    means = {r.is_mule: r.m for r in scored.groupBy("is_mule").agg(F.avg("xgboost").alias("m")).collect()}
    assert means[1] > means[0]


def test_trees_read_from_the_model_predict_alike(spark):
    m = _matrix(spark)
    ready = scoring.prepared(m, list(scoring.FEATURES)).withColumn("y", F.col("is_mule").cast("double"))
    model = GBTClassifier(featuresCol="__raw", labelCol="y", maxIter=5, maxDepth=4, seed=3).fit(ready)
    want = {r.account: r.probability[1] for r in model.transform(ready).select("account", "probability").collect()}
    trees = scoring.Trees.of(model, list(scoring.FEATURES))
    got = trees.score(m).select("account", "xgboost").collect()
    assert trees.kept == 5 and all(abs(r.xgboost - want[r.account]) < 1e-12 for r in got)
    row = trees.margins(m).filter("account = 7").first()
    assert len(row.margins) == 5 and abs(1 / (1 + math.exp(-2 * row.margins[-1])) - want[7]) < 1e-12


def test_a_longer_boosting_run_begins_like_a_shorter_one(spark):
    """What allows to begin short: the kept prefix is that of all rounds."""
    m = _matrix(spark)
    spec = TreeSpec(max_depth=2, early_stopping_rounds=2, n_estimators=40)
    first, scoring.FIRST_ROUNDS = scoring.FIRST_ROUNDS, 1
    try:
        short = scoring.fit_trees(m, m, spec)
        scoring.FIRST_ROUNDS = 40
        whole = scoring.fit_trees(m, m, spec)
    finally:
        scoring.FIRST_ROUNDS = first
    assert short.kept == whole.kept
    a, b = ({r.account: r.xgboost for r in t.score(m).collect()} for t in (short, whole))
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_prefixes_are_ranked_alike_with_and_without_shuffles(spark):
    """Counts between the mules' scores give the average precision that the ranked rows give, with ties, nulls and no mules at all."""
    m = _matrix(spark).unionByName(_matrix(spark, 120))  # repeated rows: every score is tied
    model = GBTClassifier(featuresCol="__raw", labelCol="is_mule", maxIter=7, maxDepth=2, seed=3).fit(scoring.prepared(m, list(scoring.FEATURES)))
    whole = scoring.Trees.of(model, list(scoring.FEATURES))
    counted, shuffled = scoring._prefix_precision(whole, m), scoring._prefix_precision(whole, m, cells=0)
    assert sorted(counted) == sorted(shuffled) == list(range(1, 8))
    assert np.allclose([counted[n] for n in range(1, 8)], [shuffled[n] for n in range(1, 8)], atol=1e-12)
    assert scoring._prefix_precision(whole, m.withColumn("is_mule", F.lit(0))) == {}
    one = m.filter("is_mule = 1").limit(1).unionByName(m.filter("is_mule = 0"))
    assert np.allclose(list(scoring._prefix_precision(whole, one).values()), [scoring._prefix_precision(whole, one, cells=0)[n] for n in range(1, 8)], atol=1e-12)
