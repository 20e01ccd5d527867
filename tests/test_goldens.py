"""Worked examples: each number is computed by hand, and differs from what a known mistake gives."""

from __future__ import annotations

import math
import random
from collections import defaultdict, deque
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgersift import skew
from ledgersift.config import Costs, FeatureSpec, RulesBaseline, SchemaError, SplitSpec, UnknownCurrencyError, Window, break_even_precision, build_windows, feasible_hours, load_params, ratio_windows, rehistory, replace_cost
from ledgersift.operators import briefs, evaluation, flows, graph, population, scoring, worklist
from ledgersift.plans.features import relational_features
from ledgersift.scratch import Scratch
from ledgersift.sources import ledger

D = datetime
RATES = {"USD": 0.90, "EUR": 1.0}
TXN = "ts timestamp, account_from long, account_to long, base_received double, base_paid double, is_laundering int"


def rows_of(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def txns(spark, rows):
    return spark.createDataFrame([(t, a, b, float(r), float(p), int(y)) for t, a, b, r, p, y in rows], TXN)


# amounts and accounts


@pytest.fixture
def money(spark):
    rows = [(D(2024, 3, 1), 2, 1, 100.0, "USD", 95.0, "EUR"), (D(2024, 3, 2), 3, 1, 50.0, "EUR", 50.0, "EUR"), (D(2024, 3, 3), 1, 4, 100.0, "EUR", 120.0, "USD")]
    return spark.createDataFrame(rows, "ts timestamp, account_from long, account_to long, amount_received double, receiving_currency string, amount_paid double, payment_currency string")


def test_flows_in_base_currency(money):
    got = {r.account: (r.inflow, r.outflow) for r in population.account_flows(ledger.normalise(money, RATES)).collect()}
    assert got[1] == (140.0, 108.0)  # 145/100 with swapped amounts, 150 without conversion
    assert got[4] == (100.0, 0.0) and got[2] == (0.0, 95.0)


def test_unknown_currency_is_refused_and_null_kept(money):
    with pytest.raises(UnknownCurrencyError, match="USD"):
        ledger.normalise(money, {"EUR": 1.0})
    null = money.withColumn("receiving_currency", F.lit(None).cast("string"))
    assert {r.base_received for r in ledger.normalise(null, RATES).collect()} == {None}


def test_leakage_cut_is_strict(spark):
    rows = txns(spark, [(D(2024, 3, 7, 23, 59, 59), 1, 2, 1, 1, 0), (D(2024, 3, 8), 1, 2, 1, 1, 1), (D(2024, 3, 8, 0, 0, 1), 1, 2, 1, 1, 0)])
    assert population.before(rows, D(2024, 3, 8)).count() == 1


WIN = Window("test", D(2024, 9, 5), D(2024, 9, 9), D(2024, 9, 9), D(2024, 9, 11))


def test_population_labels_and_unscoreable(spark):
    rows = txns(spark, [(D(2024, 9, 6), 9, 1, 10, 10, 0), (D(2024, 9, 9, 12), 9, 1, 5, 5, 1), (D(2024, 9, 10), 9, 7, 4, 4, 1), (D(2024, 9, 11), 9, 1, 100, 100, 1)])
    assert rows_of(population.population(rows, [WIN]), "account") == [(1,)]
    assert rows_of(population.labels(rows, [WIN]), "account", "is_mule", "exposure") == [(1, 1, 5.0)]
    assert rows_of(population.unscoreable(rows, [WIN]), "account") == [(7,)]
    summary = population.window_summary(rows, [WIN]).first()
    assert (summary.population, summary.mules, summary.unscoreable_mules, summary.reachability_ceiling) == (1, 1, 1, 0.5)
    assert rows_of(population.daily_candidates(rows, [WIN]), "account", "day") == [(1, D(2024, 9, 9))]


# windows


def test_window_layout():
    split = SplitSpec(D(2022, 9, 1), D(2022, 9, 11), 4)
    train, val, test = build_windows(split, 2)
    assert (train.feature_start, train.label_end) == (D(2022, 9, 1), D(2022, 9, 7))
    assert (val.feature_start, val.label_start, test.label_end) == (D(2022, 9, 3), D(2022, 9, 7), D(2022, 9, 11))
    assert train.label_end == val.label_start and val.label_end == test.label_start
    with pytest.raises(SchemaError):
        build_windows(SplitSpec(D(2022, 9, 1), D(2022, 9, 9), 4), 2)
    with pytest.raises(SchemaError):
        Window("w", D(2022, 9, 1), D(2022, 9, 2), D(2022, 9, 3), D(2022, 9, 4))


def test_sub_windows():
    assert ratio_windows(WIN, 24) == (D(2024, 9, 5), D(2024, 9, 8), D(2024, 9, 9))
    assert ratio_windows(WIN, 72)[1] == D(2024, 9, 6)
    with pytest.raises(SchemaError):
        ratio_windows(WIN, 96)
    assert feasible_hours(WIN, (24, 48, 72, 120)) == (24, 48, 72) and feasible_hours(WIN, (95, 96)) == (95,)
    assert rehistory(WIN, 6, D(2024, 9, 1)).feature_start == D(2024, 9, 3)
    with pytest.raises(SchemaError):
        rehistory(WIN, 9, D(2024, 9, 1))


# features


def _features(spark, rows, window=WIN, hours=24, floor=100.0):
    return {r.account: r for r in relational_features(txns(spark, rows), [window], FeatureSpec(floor), hours).collect()}


def test_pass_through(spark):
    w = Window("w", D(2024, 3, 1), D(2024, 3, 11), D(2024, 3, 11), D(2024, 3, 12))
    rows = [(D(2024, 3, 2), 5, 1, 200, 200, 0), (D(2024, 3, 7, 22), 5, 1, 300, 300, 0), (D(2024, 3, 3), 1, 6, 180, 180, 0), (D(2024, 3, 9, 6), 1, 6, 250, 250, 0), (D(2024, 3, 4), 5, 8, 99, 99, 0), (D(2024, 3, 5), 8, 6, 50, 50, 0), (D(2024, 3, 10, 12), 5, 9, 500, 500, 0)]
    got = _features(spark, rows, w, 72)
    assert got[1].pass_through_ratio == pytest.approx(0.86)  # .36 if the outflow window ended with the inflow's
    assert got[8].pass_through_ratio is None and got[9].pass_through_ratio is None  # below the floor; too late to move on
    assert got[6].out_degree == 0 and got[6].mean_amount_ratio is None and got[6].burstiness > 0


def test_next_outflow(spark):
    rows = [(D(2024, 9, 5, 12), 9, 4, 10, 10, 0), (D(2024, 9, 5, 18), 4, 9, 10, 10, 0), (D(2024, 9, 8, 12), 9, 4, 10, 10, 0), (D(2024, 9, 8, 13), 4, 9, 10, 10, 0)]
    assert _features(spark, rows)[4].median_hours_to_outflow == 6.0  # 3.5 if late inflows counted
    tie = [(D(2024, 9, 5, 12), 9, 4, 10, 10, 0), (D(2024, 9, 5, 12), 4, 9, 10, 10, 0), (D(2024, 9, 5, 14), 4, 9, 10, 10, 0)]
    assert _features(spark, tie)[4].median_hours_to_outflow == 2.0  # strictly later


def test_counterparties_and_reciprocity(spark):
    rows = [(D(2024, 9, 5), 1, 2, 30, 30, 0), (D(2024, 9, 6), 1, 2, 30, 30, 0), (D(2024, 9, 6), 3, 2, 40, 40, 0), (D(2024, 9, 7), 2, 1, 5, 5, 0), (D(2024, 9, 7), 2, 4, 5, 5, 0)]
    got = _features(spark, rows)[2]
    assert (got.in_degree, got.unique_counterparties_in, got.inflow_concentration, got.reciprocity) == (3, 2, 0.6, 0.5)
    assert got.degree_asymmetry == pytest.approx(0.2) and got.sender_diversity == pytest.approx(2 / 3) and got.active_days == 3 and got.burstiness == pytest.approx(0.4)


ORIGIN = D(2024, 9, 5)
LONG = Window("w", ORIGIN, ORIGIN + timedelta(hours=49), ORIGIN + timedelta(hours=49), ORIGIN + timedelta(hours=60))


def _fifo(spark, flow_rows, window=LONG, hours=1):
    """(account, hours, side, amount)"""
    rows = [(ORIGIN + timedelta(hours=h), 99 if s == "in" else a, a if s == "in" else 99, m, m, 0) for a, h, s, m in flow_rows]
    all_legs = flows.legs(txns(spark, rows), [window], hours).filter("account <> 99")
    return flows.fifo_pairs(all_legs)


def _pairs(df):
    return sorted((r.account, r.latency_hours, float(r.weight)) for r in df.collect())


def test_fifo_worked_example(spark):
    pairs = _fifo(spark, [(1, 0, "in", 100), (1, 10, "in", 200), (1, 30, "in", 100), (1, 12, "out", 150), (1, 40, "out", 200)])
    assert _pairs(pairs) == [(1, 2.0, 50.0), (1, 10.0, 50.0), (1, 12.0, 100.0), (1, 30.0, 150.0)]
    assert flows.weighted_median(pairs).first().fifo_latency == 12.0


def test_fifo_edges(spark):
    assert _pairs(_fifo(spark, [(1, 0, "in", 100), (1, 4, "in", 50), (1, 6, "out", 150)])) == [(1, 2.0, 50.0), (1, 6.0, 100.0)]
    both = _fifo(spark, [(1, 0, "in", 10), (1, 5, "out", 10), (2, 1, "in", 20), (2, 2, "out", 20)])
    assert _pairs(both) == [(1, 5.0, 10.0), (2, 1.0, 20.0)]
    half = _fifo(spark, [(1, 0, "in", 200), (1, 4, "out", 100), (1, 14, "out", 100)])
    assert flows.weighted_median(half).first().fifo_latency == 4.0
    early = _fifo(spark, [(1, 2, "out", 100), (1, 8, "in", 200), (1, 12, "out", 100)])
    assert _pairs(early) == [(1, 4.0, 100.0)]
    assert _pairs(_fifo(spark, [(1, 2, "out", 100), (1, 8, "in", 100), (1, 12, "out", 100)])) == []  # the axis, not a balance


def test_fifo_against_a_cumulative_queue(spark):
    rng = random.Random(4)
    rows = [(a, rng.randint(0, 47), rng.choice(["in", "out"]), rng.randint(1, 5) * 10) for a in range(12) for _ in range(14)]
    want = defaultdict(float)
    for a in range(12):
        sides = {s: deque(sorted([h, m] for b, h, x, m in rows if b == a and x == s)) for s in ("in", "out")}
        while sides["in"] and sides["out"]:
            i, o = sides["in"][0], sides["out"][0]
            w = min(i[1], o[1])
            if o[0] > i[0]:
                want[a, float(o[0] - i[0])] += w
            for side, x in (("in", i), ("out", o)):
                x[1] -= w
                if not x[1]:
                    sides[side].popleft()
    got = defaultdict(float)
    for a, h, w in _pairs(_fifo(spark, rows)):
        got[a, h] += w
    assert got == want


# scores


def _matrix(spark, rows, columns="account long, in_degree double, pass_through_ratio double, is_mule int"):
    return spark.createDataFrame(rows, columns).withColumn("window", F.lit("t"))


def test_rules(spark):
    ladder = _matrix(spark, [(i, float(i), i / 10, 0) for i in range(1, 11)])
    scored = scoring.rules_score(scoring.matched_rules_flag(ladder, 0.7))
    assert all((r.rules > 0.7) == r.matched_rules_flag for r in scored.collect()) and scored.filter("matched_rules_flag").count() == 3
    odd = _matrix(spark, [(1, 100.0, None, 1), (2, 100.0, 0.9, 0), (3, 1.0, 0.9, 0), (4, 1.0, 0.1, 0)])
    flagged = scoring.rules_flag(odd, RulesBaseline(0.4, 0.8))
    assert rows_of(flagged.filter("rules_flag"), "account") == [(2,)]
    assert {r.account: r.rules for r in scoring.rules_score(odd).collect()} == {1: 0.25, 2: 1.0, 3: 0.5, 4: 0.5}
    none = scoring.flag_summary(scoring.rules_flag(odd, RulesBaseline(1.0, 0.8)), "rules_flag").first()
    assert (none.flagged, none.precision, none.mules) == (0, 0.0, 1)


def test_log1p(spark):
    m = spark.createDataFrame([(0.0, 0.5), (math.e - 1, None)], "total_inflow double, reciprocity double")
    got = scoring.log1p_features(m, ["total_inflow"]).collect()
    assert [r.total_inflow for r in got] == [0.0, pytest.approx(1.0)] and [r.reciprocity for r in got] == [0.5, None]
    with pytest.raises(SchemaError, match="negative"):
        scoring.log1p_features(spark.createDataFrame([(-0.5,)], "total_inflow double"), ["total_inflow"])
    with pytest.raises(SchemaError, match="not a feature"):
        scoring.log1p_features(m, ["missing"])


def test_unexpected_nulls(spark):
    with pytest.raises(SchemaError, match="in_degree"):
        scoring.assert_no_unexpected_nulls(_matrix(spark, [(1, None, None, 0)]))
    scoring.assert_no_unexpected_nulls(_matrix(spark, [(1, 1.0, None, 0)]))


def test_scale_pos_weight(spark):
    assert scoring.scale_pos_weight(_matrix(spark, [(i, 1.0, 1.0, int(i == 0)) for i in range(5)])) == 4.0
    with pytest.raises(SchemaError):
        scoring.scale_pos_weight(_matrix(spark, [(1, 1.0, 1.0, 0)]))


def _scores(spark, labels, scores):
    rows = [("t", "s", i, y, float(s)) for i, (y, s) in enumerate(zip(labels, scores, strict=True))]
    return spark.createDataFrame(rows, "window string, scorer string, account long, is_mule int, score double")


def naive_ap(labels, scores):
    total, out, last = sum(labels), 0.0, 0
    for t in sorted(set(scores), reverse=True):
        hit = sum(y for y, s in zip(labels, scores, strict=True) if s >= t)
        out += hit / sum(s >= t for s in scores) * (hit - last) / total
        last = hit
    return out


def test_average_precision(spark):
    for labels, scores, want in (([1, 1, 0, 0], [4, 3, 2, 1], 1.0), ([1, 0, 1, 0], [4, 3, 2, 1], 0.8333), ([0, 0, 0, 0, 1], [5, 4, 3, 2, 1], 0.2)):
        assert evaluation.average_precision(_scores(spark, labels, scores)).first().average_precision == pytest.approx(want, abs=1e-4)
    rng = random.Random(1)
    labels, scores = [int(rng.random() < 0.3) for _ in range(200)], [rng.randint(0, 20) for _ in range(200)]
    assert evaluation.average_precision(_scores(spark, labels, scores)).first().average_precision == pytest.approx(naive_ap(labels, scores))
    assert evaluation.average_precision(_scores(spark, [0, 0], [1, 2])).first().average_precision is None


@pytest.mark.parametrize("block_rows", [100_000, 7])
def test_bootstrap_draws_equal_expanded_samples(spark, block_rows):
    """Against samples written out account by account; blocks of seven rows, and a score that more rows than that share."""
    rng = random.Random(6)
    rows = [(w, i + 100 * (w == "v"), int(rng.random() < 0.3), float(rng.randint(0, 9)), float(rng.choice([0, 0, 0, rng.random()]))) for w in "tv" for i in range(60)]
    m = spark.createDataFrame(rows, "window string, account long, is_mule int, a double, b double")
    got = {(r.window, r.scorer, r.draw): r.average_precision for r in evaluation.bootstrap_draws(m, ["a", "b"], 30, 7, block_rows=block_rows).collect()}
    assert len(got) == 2 * 2 * 30
    weights = evaluation.resample_weights(np.array([r[1] for r in rows]), np.arange(30), 7)
    assert abs(weights.mean() - 1) < 0.1 and abs(weights.var() - 1) < 0.2
    for window in "tv":
        for draw in range(30):
            sample = [r for r, w in zip(rows, weights[:, draw], strict=True) if r[0] == window for _ in range(w)]
            for scorer, at in (("a", 3), ("b", 4)):
                assert got[window, scorer, draw] == pytest.approx(naive_ap([r[2] for r in sample], [r[at] for r in sample]))


def test_bootstrap(spark):
    rng = random.Random(2)
    rows = [("t", i, int(i < 30), float(rng.random() + (i < 30)), 1.0) for i in range(200)]
    m = spark.createDataFrame([(*r[:4], r[3]) for r in rows], "window string, account long, is_mule int, a double, b double")
    draws = evaluation.bootstrap_draws(m, ["a", "b"], 50, 7)
    long = evaluation.stacked(m, ["a", "b"])
    pair = evaluation.paired_differences(draws, long, ["a", "b"]).first()
    assert (pair.difference, pair.low, pair.high, pair.crosses_zero) == (0.0, 0.0, 0.0, True)
    interval = evaluation.summarise_draws(draws, long).first()
    assert interval.low <= interval.average_precision <= interval.high
    assert rows_of(draws) == rows_of(evaluation.bootstrap_draws(m.repartition(3), ["a", "b"], 50, 7))
    with pytest.raises(SchemaError):
        evaluation.bootstrap_draws(m, ["a"], 0, 7)


def test_percentiles(spark):
    m = _matrix(spark, [(1, 1.0, None, 0), (2, 1.0, 0.5, 0), (3, 3.0, 0.7, 0)])
    got = {r.account: (r.pct_in_degree, r.pct_pass_through_ratio) for r in scoring.population_percentiles(m, ["in_degree", "pass_through_ratio"]).collect()}
    assert got == {1: (0.5, None), 2: (0.5, 0.5), 3: (1.0, 1.0)}


# worklist

DAY1, DAY2, DAY3, DAY4 = (D(2024, 1, d) for d in (1, 2, 3, 4))
QUEUE = [(DAY1, 1, 0.91, 1, 2000), (DAY1, 2, 0.88, 0, 0), (DAY1, 3, 0.74, 1, 900), (DAY1, 4, 0.51, 0, 0), (DAY1, 5, 0.30, 1, 400), (DAY2, 6, 0.60, 0, 0), (DAY2, 7, 0.40, 0, 0), (DAY2, 8, 0.20, 0, 0), (DAY2, 9, 0.05, 1, 500)]
COSTS = Costs(1150, 25, 75, 3)


def queue(spark, rows):
    return spark.createDataFrame([(a, d, float(s), y, float(e)) for d, a, s, y, e in rows], "account long, day timestamp, score double, is_mule int, exposure double").withColumn("window", F.lit("t"))


def test_operating_point(spark):
    one = worklist.evaluate(queue(spark, QUEUE[:5]), COSTS, ["window"], 1).first()
    assert (round(one.precision_at_k, 4), one.threshold, one.ev_recovered, one.ev_missed, one.net) == (0.6667, 0.74, 2750.0, 1150.0, 1600.0)
    both = worklist.evaluate(queue(spark, QUEUE), COSTS, ["window"], 2).first()
    assert (round(both.precision_at_k, 4), both.n_days, both.alerts) == (0.3333, 2, 6)
    zero = worklist.priced(worklist.coverage_curve(queue(spark, QUEUE), [0], ["window"], 2), COSTS).first()
    assert (zero.alerts, zero.recall, zero.missed, zero.threshold) == (0, 0.0, 4, None)


def test_accounts_are_opened_once_and_ties_go_to_the_lowest(spark):
    rows = [(DAY1, 5, 0.5, 0, 0), (DAY1, 3, 0.5, 0, 0), (DAY1, 9, 0.5, 0, 0), (DAY2, 3, 0.9, 0, 0), (DAY2, 9, 0.1, 0, 0)]
    for shuffled in (rows, rows[::-1]):
        got = worklist.select_alerts(queue(spark, shuffled), [2], ["window"], 2)
        assert rows_of(got, "day", "account") == [(DAY1, 3), (DAY1, 5), (DAY2, 9)]
    with pytest.raises(SchemaError):
        worklist.select_alerts(queue(spark, rows), [-1], ["window"], 2)
    with pytest.raises(SchemaError):
        worklist.select_alerts(queue(spark, rows).drop("score"), [1], ["window"], 2)


def test_selection_against_a_loop(spark):
    rng = random.Random(8)
    rows = [(D(2024, 1, d), a, rng.randint(0, 6) / 10, 0, 0) for d in (1, 2, 3) for a in rng.sample(range(40), 25)]
    q = queue(spark, rows)
    got = worklist.select_alerts(q, [0, 1, 3, 7, 50], ["window"], 3).collect()
    for k in (0, 1, 3, 7, 50):
        want, seen = set(), set()
        for day in (1, 2, 3):
            today = sorted(((-s, a) for d, a, s, *_ in rows if d.day == day and a not in seen))[:k]
            seen |= {a for _, a in today}
            want |= {(day, a) for _, a in today}
        assert {(r.day.day, r.account) for r in got if r.k == k} == want


def test_rollover(spark):
    rows = [(DAY1, 1, 0.9, 0, 0), (DAY1, 2, 0.8, 0, 0), (DAY2, 3, 0.1, 0, 0)]
    pick = lambda policy: [a for _, a in rows_of(worklist.select_alerts(worklist.apply_policy(queue(spark, rows), policy, ["window"]), [1], ["window"], 2), "day", "account")]
    assert pick("same_day") == [1, 3] and pick("rollover_max_3d") == [1, 2]
    late = [(DAY1, 1, 0.9, 0, 0), (DAY1, 2, 0.1, 0, 0), (DAY2, 3, 0.8, 0, 0), (DAY3, 4, 0.7, 0, 0), (DAY4, 5, 0.05, 0, 0)]
    carried = worklist.apply_policy(queue(spark, late), "rollover_max_3d", ["window"])
    assert [a for _, a in rows_of(worklist.select_alerts(carried, [1], ["window"], 4), "day", "account")] == [1, 3, 4, 5]
    assert rows_of(carried.select("day").distinct()) == [(DAY1,), (DAY2,), (DAY3,), (DAY4,)]
    with pytest.raises(SchemaError):
        worklist.apply_policy(queue(spark, rows), "whenever", ["window"])


def test_best_volume_and_break_even(spark):
    ladder = queue(spark, [(DAY1, i, 1 - i / 100, int(i in (1, 5, 20)), 0) for i in range(1, 101)])
    curve = worklist.coverage_curve(ladder, [0, 1, 5, 20, 100], ["window"], 1)
    best = lambda miss: worklist.volume_optimum(worklist.priced(curve, Costs(miss, 25, 75, 3)), ["window"]).first().optimal_k
    assert [best(m) for m in (10, 100, 500, 2000)] == [0, 1, 5, 20]
    even = worklist.break_even_curve(ladder, Costs(1150, 25, 75, 3), [0.1, 1.0, 5.0, 20.0], [0, 1, 5, 20, 100], ["window"], 1)
    assert worklist.crossing_ratio(even, 3, ["window"]).first().crossing_ratio == 5.0
    assert worklist.crossing_ratio(even, 100, ["window"]).first().crossing_ratio is None
    edge = worklist.break_even_curve(ladder, COSTS, [1000.0], [0, 1, 5], ["window"], 1).first()
    assert edge.optimal_at_grid_edge and edge.budget_binds
    assert round(break_even_precision(COSTS, 0), 6) == 0.081633 and round(break_even_precision(COSTS, 15612.8), 6) == 0.005939
    with pytest.raises(SchemaError):
        worklist.coverage_curve(ladder, [], ["window"], 1)


def test_sensitivity(spark):
    got = worklist.sensitivity(queue(spark, QUEUE), COSTS, [0.5, 1.0, 2.0], ["window"], 2)
    assert got.count() == 12
    assert [r.alerts for r in got.filter("parameter = 'analyst_capacity_per_day'").orderBy("value").collect()] == [2, 6, 9]  # at 6 a day: all 5 and all 4
    with pytest.raises(SchemaError, match="categorical"):
        replace_cost(COSTS, "queue_overflow_policy", 2)
    with pytest.raises(SchemaError, match="not a cost"):
        replace_cost(COSTS, "capacity", 2)
    assert replace_cost(COSTS, "analyst_capacity_per_day", 4.9).analyst_capacity_per_day == 4


def test_overflow(spark):
    table = spark.createDataFrame([("t", s, p, c) for s, a, b in (("x", 3, 5), ("y", 4, 4), ("z", 5, 2)) for p, c in (("same_day", a), ("rollover_max_3d", b))], "window string, scorer string, policy string, caught long")
    assert tuple(worklist.overflow_verdict(table, "same_day").first()) == (1, 1, 1, 2, 3)
    with pytest.raises(SchemaError):
        worklist.overflow_verdict(table, "other")
    q = queue(spark, [(DAY1, 1, 0.9, 0, 0), (DAY1, 2, 0.8, 1, 0), (DAY2, 3, 0.1, 0, 0)]).withColumn("scorer", F.lit("s"))
    got = {r.policy: (r.carried_alerts, r.caught, r.queue_rows) for r in worklist.overflow_comparison(q, Costs(1150, 25, 75, 1), 2).collect()}
    assert got == {"same_day": (0, 0, 3), "rollover_max_3d": (1, 1, 5)}


def test_candidates_are_complete(spark):
    scored = spark.createDataFrame([("t", 1, 0.5, 0, 1.0)], "window string, account long, rules double, is_mule int, exposure double")
    days = spark.createDataFrame([("t", 1, DAY1)], "window string, account long, day timestamp")
    assert worklist.build_candidates(days, scored, ["rules"]).count() == 1
    with pytest.raises(SchemaError, match="not in the scored"):
        worklist.build_candidates(days.withColumn("account", F.lit(5).cast("long")), scored, ["rules"])
    with pytest.raises(SchemaError, match="undefined"):
        worklist.build_candidates(days, scored.withColumn("rules", F.lit(None).cast("double")), ["rules"])


# drift


def _values(spark, reference, comparison, feature="f"):
    return spark.createDataFrame([(feature, "reference", None if v is None else float(v)) for v in reference] + [(feature, "comparison", None if v is None else float(v)) for v in comparison], "feature string, side string, value double")


def test_psi(spark):
    low, far = range(1, 13), range(20, 32)
    psi = lambda a, b, bins=2, eps=1e-6: evaluation.drift_table(_values(spark, a, b), bins=bins, epsilon=eps).first()
    assert psi(low, low).psi == 0.0
    r = [1.0] * 4 + [2.0] * 4 + [3.0] * 2
    assert psi(low, far, 4).psi == pytest.approx(sum((c - r0) * math.log(c / r0) for c, r0 in [(1e-6 / (1 + 3e-6), 0.25)] * 3 + [(1 / (1 + 3e-6), 0.25)]))
    assert psi(low, far, 4).empty_bins == 3 and psi(low, far, 4).epsilon_dependent and psi(low, far, 4).reading == "significant shift"
    flat = psi([0] * 99 + [5], [900] * 100, 10)
    assert flat.psi == pytest.approx(0.0) and flat.empty_bins == 9
    empty = psi([None], [1.0])
    assert empty.psi is None and empty.reading.startswith("undefined") and empty.reference_null_share == 1.0
    with pytest.raises(SchemaError):
        psi(low, far, 1)
    del r


def test_ks(spark):
    assert evaluation.ks_statistic(_values(spark, range(10), range(10))).first().ks == 0.0
    assert evaluation.ks_statistic(_values(spark, range(10), range(50, 60))).first().ks == 1.0


# graph


def _edges(spark, pairs):
    return spark.createDataFrame([("t", a, b) for a, b in pairs], "window string, src long, dst long")


def test_graph_shapes(spark):
    s = lambda: Scratch(spark, "t")
    shapes = {"path": ([(1, 2), (2, 3)], (3, 2, 1, 0)), "triangle": ([(1, 2), (2, 3), (3, 1)], (3, 3, 1, 1)), "star": ([(1, 2), (1, 3), (1, 4)], (4, 3, 1, 0)), "mutual": ([(1, 2), (2, 1)], (2, 1, 1, 0)), "two": ([(1, 2), (3, 4), (4, 5)], (5, 3, 2, 0))}
    for pairs, want in shapes.values():
        e = _edges(spark, pairs)
        p = graph.component_profile(graph.component_table(e, graph.components(e, s()))).first()
        assert (p.nodes, p.edges, p.components, p.components_with_a_cycle) == want
    stats = graph.graph_stats(_edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])).first()
    assert (stats.triangles, stats.accounts_in_a_triangle, stats.directed_edges, stats.mean_degree, stats.zero_triangle_share) == (1, 3, 4, 2.0, 0.25)
    both = graph.graph_stats(_edges(spark, [(1, 2), (2, 1)])).first()
    assert (both.directed_edges, both.undirected_edges) == (2, 1)


def test_graph_against_brute_force(spark):
    rng = random.Random(9)
    pairs = {(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(110)}
    pairs = {(a, b) for a, b in pairs if a != b}
    e = _edges(spark, pairs)
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    got = {r.node: r.triangles for r in graph.triangles(e).collect()}
    assert got == {n: sum(1 for x in near[n] for y in near[n] if x < y and y in near[x]) for n in near}
    label = {n: n for n in near}
    for _ in near:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.node: r.component for r in graph.components(e, Scratch(spark, "t")).collect()} == label
    chain = _edges(spark, [(i, i + 1) for i in range(1, 70)])
    assert {r.component for r in graph.components(chain, Scratch(spark, "t")).collect()} == {1}
    n, out, d = len(near), defaultdict(set), 0.85
    for a, b in pairs:
        out[a].add(b)
    rank = {v: 1 / n for v in near}
    for _ in range(100):
        lost = sum(r for v, r in rank.items() if not out[v])
        new = {v: (1 - d) / n + d * lost / n for v in near}
        for a in out:
            for b in out[a]:
                new[b] += d * rank[a] / len(out[a])
        change = sum(abs(new[v] - rank[v]) for v in near)
        rank = new
        if change < 1e-6:
            break
    spark_rank = {r.node: r.pagerank for r in graph.pagerank(e, Scratch(spark, "t")).collect()}
    assert spark_rank == pytest.approx(rank, abs=1e-12) and sum(spark_rank.values()) == pytest.approx(1.0)


def test_component_bands(spark):
    accounts = spark.createDataFrame([(1,), (2,), (9,)], "account long")
    e = _edges(spark, [(1, 2)])
    labels = graph.components(e, Scratch(spark, "t"))
    sized = graph.account_component_sizes(accounts, labels, graph.component_table(e, labels))
    assert rows_of(sized, "account", "component_size") == [(1, 2), (2, 2), (9, 0)]
    bands = graph.band_table(sized, "all").orderBy("band_no").collect()
    assert [r.accounts for r in bands] == [1, 0, 2, 0, 0] and sum(r.share for r in bands) == pytest.approx(1.0)


# briefs


def test_briefs(spark):
    values = {c: 0.0 for c in briefs.COLUMNS} | {"in_degree": 1200.0, "pass_through_ratio": 0.97, "total_inflow": 5e6, "sender_diversity": 0.5}
    pct = {f"pct_{c}": 0.1 for c in briefs.COLUMNS} | {"pct_in_degree": 0.96, "pct_pass_through_ratio": 0.99, "pct_total_inflow": 0.97, "pct_sender_diversity": 0.98, "pct_burstiness": None}
    types = ", ".join(f"{c} double" for c in (*values, *pct))
    row = spark.createDataFrame([(*values.values(), *pct.values())], types)
    got = row.select(briefs.standout_phrases(0.95).alias("p"), briefs.next_step(0.95).alias("s"), briefs.next_step(0.995).alias("none")).first()
    assert got.p == ["received payments from 1,200 different accounts", "sent on 97% of the money that came in", "took in 5,000,000 EUR of inflow over the history window"]
    assert got.s == briefs.ONWARD and got.none == briefs.OTHER
    q = spark.createDataFrame([("t", 7, DAY1, 0.5, 0, 1.0), ("t", 7, DAY2, 0.5, 0, 1.0), ("t", 3, DAY1, 0.5, 0, 2.0), ("t", 1, DAY1, 0.9, 1, 3.0)], "window string, account long, day timestamp, score double, is_mule int, exposure double")
    assert [(r.account, r.rank, r.alerts) for r in briefs.rank_alerts(q).orderBy("rank").collect()] == [(1, 1, 3), (3, 2, 3), (7, 3, 3)]
    text = briefs.render({"account": 1, "rank": 1, "alerts": 3, "score": 0.9, "exposure": 1234.0, "standouts": [], "next_step": briefs.OTHER}, "rules")
    assert "1,234 EUR" in text and "Nothing above" in text


def test_params(monkeypatch, tmp_path):
    from ledgersift.config import default_params_path

    params = load_params()
    assert params.fx_to_base["Yen"] == 0.006 and params.costs.analyst_capacity_per_day == 200 and params.logistic.log1p_features[0] == "in_degree"
    monkeypatch.setenv("PARAMS_PATH", "config/params_hi_small.yaml")
    other = load_params(default_params_path())
    assert (other.data.expected_rows, other.data.drop_self_transfers, other.paths.raw_dir) == (5078345, True, params.paths.raw_dir)
    assert other.costs == params.costs and other.paths.reports_dir.name == "hi-small"
    monkeypatch.setenv("PARAMS_PATH", "config/none.yaml")
    with pytest.raises(SchemaError):
        default_params_path()
    (tmp_path / "bad.yaml").write_text("- 1\n")
    with pytest.raises(SchemaError, match="mapping"):
        load_params(tmp_path / "bad.yaml")
    assert Decimal("1.0") == 1


# selection and quantiles at any size


def _brute_alerts(rows, k, n_days):
    """(account, day number, score) -> picked (day, account)."""
    opened, out = set(), []
    for d in range(n_days):
        today = sorted((-s, a) for a, day, s in rows if day == d and a not in opened)[:k]
        opened |= {a for _, a in today}
        out += [(d, a) for _, a in today]
    return sorted(out)


def _day_queue(spark, rows):
    start = datetime(2024, 1, 1)
    made = [("w", a, start + timedelta(days=d), s, 0, 1.0) for a, d, s in rows]
    return spark.createDataFrame(made, "window string, account long, day timestamp, score double, is_mule int, exposure double")


def test_fourteen_days_keep_the_plan_linear(spark):
    rng = random.Random(8)
    rows = [(a, d, float(rng.randint(0, 6))) for d in range(14) for a in rng.sample(range(80), 40)]
    got = worklist.select_alerts(_day_queue(spark, rows), [3, 5], ["window"], 14)
    start = datetime(2024, 1, 1)
    for k in (3, 5):
        assert sorted(((r.day - start).days, r.account) for r in got.filter(F.col("k") == k).collect()) == _brute_alerts(rows, k, 14)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 14


@pytest.mark.parametrize("most", [1000, 0])
def test_large_volumes_rank_over_range_partitions(spark, monkeypatch, most):
    rng = random.Random(9)
    rows = [(a, d, float(rng.randint(0, 50))) for d in range(3) for a in rng.sample(range(400), 300)]
    monkeypatch.setattr(worklist, "PRUNED_IN_TASK", most)
    monkeypatch.setattr(skew.running_totals, "__kwdefaults__", {"window_rows": 10})
    monkeypatch.setattr(skew.positions, "__kwdefaults__", {"window_rows": 10})
    got = worklist.select_alerts(_day_queue(spark, rows), [0, 20, 250, 20_000], ["window"], 3)
    start = datetime(2024, 1, 1)
    for k in (20, 250, 20_000):
        assert sorted(((r.day - start).days, r.account) for r in got.filter(F.col("k") == k).collect()) == _brute_alerts(rows, k, 3)


def test_a_volume_of_twenty_thousand_makes_no_window_over_a_group(spark, monkeypatch):
    """Beyond the rank that Spark cuts off in each task, and beyond what one window may take, rows are ranked inside range partitions."""
    monkeypatch.setattr(skew.positions, "__kwdefaults__", {"window_rows": 10})
    seen = []
    real = skew.running_totals
    monkeypatch.setattr(skew, "running_totals", lambda df, keys, *rest, **kw: seen.append((tuple(keys), real(df, keys, *rest, **kw))) or seen[-1][1])
    rows = [(a + 200 * d, d, float(a % 7)) for d in range(2) for a in range(200)]
    worklist.select_alerts(_day_queue(spark, rows), [20_000], ["window"], 2)
    assert len(seen) == 3
    for _, plan in seen:
        assert "__part" in plan._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("window_rows", [2_000_000, 5])
def test_exact_quantiles(spark, window_rows):
    rng = random.Random(10)
    rows = [(k, rng.choice([None, float(rng.randint(0, 9)), rng.random()])) for k in "ab" for _ in range(101)] + [("c", None), ("d", 4.0)]
    frame = spark.createDataFrame(rows, "key string, x double")
    shares = [0.0, 0.05, 0.5, 0.9, 0.99, 1.0]
    got = {r.key: r.quantiles for r in skew.exact_quantiles(frame, ["key"], "x", shares, Scratch(spark, "t"), "q", window_rows=window_rows).collect()}
    assert set(got) == {"a", "b", "d"}
    for key, found in got.items():
        assert found == pytest.approx(np.quantile([x for k, x in rows if k == key and x is not None], shares).tolist())


def test_pagerank_in_a_task_equals_joins(spark):
    rng = random.Random(12)
    rows = [(w, rng.randint(0, n), rng.randint(0, n)) for w, n in (("a", 30), ("b", 200)) for _ in range(n * 2)]
    e = spark.createDataFrame(sorted({r for r in rows if r[1] != r[2]}), "window string, src long, dst long")
    read = lambda task_edges: {(r.window, r.node): r.pagerank for r in graph.pagerank(e, Scratch(spark, "t"), tol=1e-3, task_edges=task_edges).collect()}
    one, other, both = read(10**6), read(0), read(100)
    assert one.keys() == other.keys() == both.keys() and len(one) > 200
    assert all(abs(one[k] - other[k]) < 1e-12 and abs(one[k] - both[k]) < 1e-12 for k in one)
