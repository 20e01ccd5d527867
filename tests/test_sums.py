"""Sums that are ranked: the same whatever the order of the rows, so equal payments give equal totals, shares and percentiles."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from ledgersift.config import FeatureSpec, Window
from ledgersift.functions.scalars import places
from ledgersift.functions.sums import exact_total, merged_parts, sum_parts
from ledgersift.operators import briefs, population, scoring
from ledgersift.plans.features import relational_features
from tests.test_goldens import TXN

D = datetime
WINDOW = Window("test", D(2024, 1, 1), D(2024, 1, 5), D(2024, 1, 5), D(2024, 1, 7))
SPEC = FeatureSpec(min_flow_eur=1, pagerank_damping=0.85, pagerank_max_iter=10, pagerank_tol=1e-6)
AMOUNTS = [round(random.Random(3).uniform(0.01, 900), 2) * 0.9 + i * 0.1 for i in range(40)]


def _ledger(spark, label=False):
    """Thirty accounts with the same payments from one sender each, in thirty orders."""
    rng, rows = random.Random(7), []
    for account in range(30):
        amounts = rng.sample(AMOUNTS, len(AMOUNTS))
        start = D(2024, 1, 5 if label else 1)
        rows += [(start + timedelta(minutes=i), 1000 + account, account, a, a, 0) for i, a in enumerate(amounts)]
    return spark.createDataFrame(rows, TXN)


def test_exact_sum(spark):
    values = {1: [0.1, 0.2], 2: [0.3], 3: AMOUNTS, 4: AMOUNTS[::-1], 5: [None], 6: [1e300, 1.0], 7: [-0.7, 0.1, 5e9], 8: [float("nan"), 1.0], 9: [1e-3, None]}
    df = spark.createDataFrame([(k, i % 3, v) for k, vs in values.items() for i, v in enumerate(vs)], "k int, part int, v double").repartition(5)
    parts = df.groupBy("k", "part").agg(*sum_parts(F.col("v"), "s")).groupBy("k").agg(*merged_parts("s"))
    got = {r.k: r.s for r in parts.select("k", exact_total("s").alias("s")).collect()}
    want = {k: math.fsum(v for v in vs if v is not None) if any(v is not None for v in vs) else None for k, vs in values.items() if k != 8}
    assert math.isnan(got.pop(8)) and got == want


def test_equal_payments_tie_in_percentiles(spark):
    for txns in (_ledger(spark), _ledger(spark).repartition(7)):
        matrix = relational_features(txns, [WINDOW], SPEC, 24)
        assert matrix.select("total_inflow", "pass_through_ratio").distinct().collect() == [(math.fsum(AMOUNTS), 0.0)]
        assert matrix.select("inflow_concentration").distinct().collect() == [(1.0,)]
        got = scoring.population_percentiles(matrix, briefs.COLUMNS)
        assert [tuple(r) for r in got.select("pct_total_inflow", "pct_inflow_concentration").distinct().collect()] == [(15.5 / 30, 15.5 / 30)]


def test_equal_payments_tie_in_exposure(spark):
    txns = _ledger(spark).unionByName(_ledger(spark, label=True))
    assert [r.exposure for r in population.labels(txns, [WINDOW]).select("exposure").distinct().collect()] == [math.fsum(AMOUNTS)]


def test_two_decimals_as_sql_has_them(spark):
    values = [a / b for b in (8, 40, 200, 347) for a in range(b + 1)]
    got = [r[1] for r in spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", places(F.col("v"))).orderBy("i").collect()]
    wanted = duckdb.sql("SELECT printf('%.2f', round(v, 2)) FROM (SELECT unnest(" + repr(values) + "::DOUBLE[]) AS v)").fetchall()
    assert got == [w for (w,) in wanted] and places_of(spark, 0.575) == "0.57"


def places_of(spark, value):
    return spark.range(1).select(places(F.lit(value))).first()[0]
