"""Stages of the whole run, each from tables to tables and a metrics file; ``python -m ledgersift.plans.stages STAGE`` runs one.

    ingest -> features -> models -> economics -> monitoring -> report -> figures
    window-scan | components | sweep | brief
"""

from __future__ import annotations

import logging
import sys
from collections.abc import Sequence
from datetime import timedelta
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersift.config import LABEL, SCORERS, SPLITS, Costs, Params, SchemaError, Window, build_windows, feasible_hours, load_params, ratio_windows, read_metrics, rehistory, write_metrics
from ledgersift.operators import briefs, evaluation, graph, population, scoring, worklist
from ledgersift.operators.evaluation import long_values, stacked
from ledgersift.plans import contract, report
from ledgersift.plans import figures as drawings
from ledgersift.plans.features import build_features, history_scan
from ledgersift.scratch import Scratch
from ledgersift.sources import ledger
from ledgersift.session import build_session

LOG = logging.getLogger(__name__)
KEYS = ["window", "scorer"]


def records(df: DataFrame) -> list[dict]:
    """Rows of a small frame as dicts."""
    return [r.asDict(recursive=True) for r in df.collect()]


def _interim(spark: SparkSession, params: Params, root: Path | None) -> str:
    """The folder of the stages' tables: beside the settings on one machine, in the warehouse, which executors share, on a cluster."""
    if root is not None:
        return f"{root}/data/interim"
    if spark.sparkContext.master.startswith("local"):
        return str(params.paths.interim_dir)
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/ledgersift-{params.data.variant}"


class Run:
    """Paths, settings and windows of one run."""

    def __init__(self, spark: SparkSession, params: Params, root: Path | None = None):
        self.spark, self.params = spark, params
        self.windows = build_windows(params.split, params.label_window_days)
        self.interim = _interim(spark, params, root)
        self.reports = root / "reports" if root else params.paths.reports_dir
        self.raw = f"{params.paths.raw_dir}/{params.data.trans_file}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.interim}/{name}.parquet")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.interim}/{name}.parquet")
        return self.table(name)

    def metrics(self, name: str, payload: dict) -> dict:
        write_metrics(self.reports / f"metrics_{name}.json", payload)
        return payload


def ingest(run: Run, path: str | None = None, *, check_contract: bool = True) -> dict:
    params = run.params
    loaded = ledger.load_csv(run.spark, path or run.raw, drop_self_transfers=params.data.drop_self_transfers)
    if check_contract:
        ledger.validate_contract(loaded, params.data)
    span = records(ledger.observed_span(loaded.transactions))[0]
    daily = records(population.daily_volume(loaded.transactions).withColumn("day", F.date_format("day", "yyyy-MM-dd")).orderBy("day"))
    priced = ledger.usable_span(ledger.normalise(loaded.transactions, params.fx_to_base), params.split.data_start, params.split.data_end)
    txns = run.keep(priced.repartitionByRange("ts"), "canonical_txns")  # files by time: windows prune them
    counts = {
        "rows_read": loaded.rows, "accounts": loaded.n_accounts, "self_transfers_dropped": loaded.self_transfers if params.data.drop_self_transfers else 0,
        "laundering_in_self_transfers": loaded.laundering_dropped, "usable_rows": txns.count(),
    }
    return run.metrics("data", contract.data(counts, span, daily, records(population.window_summary(txns, run.windows)), run.windows, params))


def features(run: Run) -> DataFrame:
    scratch = Scratch(run.spark, "features")
    out = run.keep(build_features(run.table("canonical_txns"), run.windows, run.params.features, run.params.pass_through_window_hours, scratch), "features")
    scoring.assert_no_unexpected_nulls(out)
    return out


def _of(matrix: DataFrame, window: str) -> DataFrame:
    return matrix.filter(F.col("window") == window)


def score_all(matrix: DataFrame, params: Params, scorers: Sequence[str] = SCORERS, rounds: int | None = None) -> tuple[DataFrame, dict]:
    """All scorers as columns, and what their fits report."""
    facts: dict = {}
    out = scoring.rules_score(matrix)
    if "logistic" in scorers:
        out = scoring.fit_logistic(_of(matrix, "train"), params.logistic, params.seed).score(out)
    if "xgboost" in scorers:
        trees = scoring.fit_trees(_of(matrix, "train"), _of(matrix, "val"), params.model, params.seed, rounds)
        out = trees.score(out)
        weight, n = scoring.scale_pos_weight(_of(matrix, "train"), counted=True)
        mules = round(n / (1 + weight))
        facts |= {"trees_kept": trees.kept, "importance": dict(trees.importance()), "scale_pos_weight": weight, "train_mules": mules, "train_clean": n - mules}
    return out, facts


def models(run: Run, rounds: int | None = None) -> dict:
    params, matrix = run.params, run.table("features")
    scored, facts = score_all(matrix, params, rounds=rounds)
    scored = scoring.matched_rules_flag(scoring.rules_flag(scored, params.rules), params.rules.in_degree_percentile)
    scored = run.keep(scored.select("window", "account", *SCORERS, "rules_flag", "matched_rules_flag", LABEL, "exposure"), "scores")
    long = stacked(scored, SCORERS)
    later = scored.filter(F.col("window") != "train")
    draws = evaluation.bootstrap_draws(later, SCORERS, params.bootstrap_resamples, params.seed)
    draws = Scratch(run.spark, "draws").save(draws, "draws")
    rest = long.filter(F.col("window") != "train")
    ranking = records(evaluation.pr_table(long))
    flags = {kind: records(scoring.flag_summary(scored, column)) for kind, column in (("configured", "rules_flag"), ("matched", "matched_rules_flag"))}
    told = contract.models(
        facts, ranking, records(evaluation.summarise_draws(draws, rest)), records(evaluation.paired_differences(draws, rest, SCORERS)), flags, records(scoring.null_rates(matrix)), params
    )
    return run.metrics("models", told | {"ranking": ranking, "rules_diagnostics": records(scoring.rules_diagnostics(matrix, params.rules))})


def _queues(run: Run, scored: DataFrame) -> DataFrame:
    later = run.windows[1:]
    both = scored.filter(F.col("window").isin([w.name for w in later]))
    return Scratch(run.spark, "queues").save(worklist.build_candidates(population.daily_candidates(run.table("canonical_txns"), later), both, SCORERS), "queues")


def volume_grid(ceiling: int, points: int, *more: int) -> list[int]:
    """Whole volumes spaced evenly on a logarithmic scale."""
    return sorted({int(round(v)) for v in np.geomspace(1, max(ceiling, 1), points)} | set(more))


def economics(run: Run) -> dict:
    params, costs, days = run.params, run.params.costs, run.params.label_window_days
    raw = _queues(run, run.table("scores"))
    scratch = Scratch(run.spark, "economics")
    queue = scratch.save(worklist.apply_policy(raw, costs.queue_overflow_policy, KEYS), "queue")
    test = queue.filter("window = 'test'")
    ceiling = test.groupBy("scorer", "day").count().agg(F.max("count")).first()[0] or 1
    grid = volume_grid(ceiling, 60, costs.analyst_capacity_per_day)
    even = scratch.save(worklist.break_even_curve(test, costs, list(np.geomspace(1e-3, 1e3, 19)), grid, KEYS, days), "even")
    overflow = scratch.save(worklist.overflow_comparison(raw, costs, days), "overflow")
    optimum = worklist.volume_optimum(worklist.priced(worklist.coverage_curve(test, grid, KEYS, days), costs), KEYS)
    point = scratch.save(worklist.evaluate(queue, costs, KEYS, days), "point")
    lost = population.window_summary(run.table("canonical_txns"), run.windows).select("window", "unscoreable_mules")
    exposure = records(worklist.exposure_concentration(test, costs, KEYS))
    moved = records(worklist.sensitivity(test, costs, params.multipliers, KEYS, days))
    compared = records(overflow)
    told = contract.economics(
        records(point), records(even), exposure, compared, records(worklist.overflow_verdict(overflow, costs.queue_overflow_policy))[0], moved, records(optimum), ceiling, costs
    )
    LOG.info("costs moved one at a time (%s)\n%s", costs.as_footer(), report.moved_table(contract.of(moved)))
    LOG.info("queue policies\n%s", report.overflow_table(compared))
    return run.metrics("economics", told | {
        "by_scorer": {
            "operating_point": records(point), "volume_curve": records(worklist.priced(worklist.coverage_curve(test, volume_grid(min(ceiling, 20_000), 50), KEYS, days), costs)),
            "break_even_curve": records(even), "crossing_ratio": records(worklist.crossing_ratio(even, costs.analyst_capacity_per_day, KEYS)), "sensitivity": moved, "exposure": exposure,
            "against_chance": records(worklist.against_chance(point, worklist.exposure_concentration(queue, costs, KEYS), lost)),
        },
    })


def monitoring(run: Run) -> dict:
    spec, matrix, scores = run.params.monitoring, run.table("features"), run.table("scores")
    if spec.reference_window not in SPLITS:
        raise SchemaError(f"unknown reference window {spec.reference_window!r}")
    columns, features_, scores_ = scoring.feature_columns(matrix), {}, {}
    for later in (s for s in SPLITS if s != spec.reference_window):
        drift = evaluation.drift_table(long_values(matrix, columns, spec.reference_window, later), bins=spec.bins, epsilon=spec.epsilon)
        features_[later] = records(drift.orderBy(F.desc_nulls_last("psi"), "feature"))
        values = long_values(scores, SCORERS, spec.reference_window, later)
        scores_[later] = records(evaluation.drift_table(values, bins=spec.bins, epsilon=spec.epsilon).join(evaluation.ks_statistic(values), "feature", "left"))
    return run.metrics("monitoring", contract.monitoring(features_, scores_, run.params))


def write_report(run: Run) -> str:
    got = {n: read_metrics(run.reports / f"metrics_{n}.json") for n in ("data", "models", "economics", "monitoring")}
    text = report.build(got["data"], got["models"], got["economics"], got["monitoring"], run.params.costs)
    (run.reports / "report.md").write_text(text, encoding="utf-8")
    return text


def figures(run: Run) -> list[str]:
    """All figures, from the tables and metrics of the earlier stages."""
    data, economy, costs, test = read_metrics(run.reports / "metrics_data.json"), read_metrics(run.reports / "metrics_economics.json"), run.params.costs, run.windows[-1]
    scores, best = run.table("scores"), contract.SCORER
    later = stacked(scores.filter(F.col("window") != "train"), SCORERS)
    queue = Scratch(run.spark, "figures").save(_queues(run, scores).filter((F.col("window") == test.name) & (F.col("scorer") == best)), "queue")
    alerts = worklist.select_alerts(worklist.apply_policy(queue, costs.queue_overflow_policy, KEYS), [costs.analyst_capacity_per_day], KEYS, run.params.label_window_days)
    funnel = drawings.funnel_stages(queue, population.unscoreable(run.table("canonical_txns"), [test]), alerts).orderBy("stage_no")
    rates = {r["window"]: r["base_rate"] for r in records(evaluation.pr_table(later).select("window", "base_rate").distinct())}
    return drawings.draw_all(
        run.reports / "figures", costs, daily=[{"day": d, "payments": v["transactions"], "laundering": v["laundering"], "share": v["laundering_share"]} for d, v in sorted(data["daily"].items())], cutoff=f"{run.params.split.data_end:%Y-%m-%d}",
        curves=records(evaluation.pr_curve(later).orderBy("window", "scorer", "recall")), base_rates=rates, funnel=records(funnel),
        exposure=contract.of(economy["by_scorer"]["exposure"])[0], budget=economy["by_scorer"]["volume_curve"],
    )


def window_scan(run: Run) -> dict:
    test = run.windows[-1]
    days = [d for d in run.params.experiments.history_window_days if test.label_start - timedelta(days=d) >= run.params.split.data_start]
    histories = [rehistory(test, d, run.params.split.data_start) for d in days]
    rows = records(history_scan(run.table("canonical_txns"), histories))
    if len({r["mules_in_window"] for r in rows}) > 1:
        raise SchemaError("the label window's mules changed with the history length: labels read the history")
    return run.metrics("window_scan", contract.window_scan(rows, histories, test, run.params))


def component_stage(run: Run) -> dict:
    scratch, test = Scratch(run.spark, "components"), run.windows[-1:]
    edge_rows = scratch.save(graph.edges(run.table("canonical_txns"), test), "edges")
    named = scratch.save(graph.components(edge_rows, scratch), "named")
    table = graph.component_table(edge_rows, named)
    scored = run.table("scores").filter(F.col("window") == test[0].name).select("account", LABEL)
    queue = _queues(run, run.table("scores")).filter((F.col("window") == test[0].name) & (F.col("scorer") == contract.SCORER))
    alerted = worklist.select_alerts(worklist.apply_policy(queue, run.params.costs.queue_overflow_policy, KEYS), [run.params.costs.analyst_capacity_per_day], KEYS, run.params.label_window_days)
    sets = {f"alerted by {contract.SCORER}": alerted, "reachable mules": scored.filter(F.col(LABEL) == 1), "whole scoring population": scored}
    bands = [r for name, accounts in sets.items() for r in records(graph.band_table(graph.account_component_sizes(accounts.select("account").distinct(), named, table), name).orderBy("band_no"))]
    return run.metrics("components", contract.components(test[0].name, records(graph.component_profile(table))[0], bands))


def passthrough_sweep(txns: DataFrame, windows: Sequence[Window], params: Params, costs: Costs, scratch: Scratch, scorers: Sequence[str] = SCORERS, rounds: int | None = None) -> DataFrame:
    """Every scorer's operating point in the test window for each feasible pass-through extension."""
    days, test = params.label_window_days, windows[-1]
    candidates = population.daily_candidates(txns, [test])
    ranks = scratch.save(graph.pagerank(graph.edges(txns, windows), scratch, damping=params.features.pagerank_damping, max_iter=params.features.pagerank_max_iter, tol=params.features.pagerank_tol), "ranks")
    out = None
    for hours in feasible_hours(test, params.experiments.pass_through_sweep_hours):
        from ledgersift.plans.features import relational_features

        plain = relational_features(txns, windows, params.features, hours).join(ranks.withColumnRenamed("node", "account"), ["window", "account"], "left").fillna(0.0, ["pagerank"])
        matrix = scratch.save(plain.join(population.labels(txns, windows), ["window", "account"]).select("window", "account", *scoring.FEATURES, LABEL, "exposure"), f"matrix-{hours}")
        scored, facts = score_all(matrix, params, scorers, rounds)
        queue = worklist.build_candidates(candidates, _of(scored, test.name), scorers)
        point = worklist.evaluate(worklist.apply_policy(scratch.save(queue, f"queue-{hours}"), costs.queue_overflow_policy, KEYS), costs, KEYS, days)
        start, end, _ = ratio_windows(test, hours)
        row = point.select(F.lit(hours).alias("hours"), "scorer", F.lit(int((end - start).total_seconds() // 3600)).alias("inflow_hours"), "caught", "alerts", "precision_at_k", "threshold", "net_per_day", F.lit(facts.get("trees_kept", 0)).alias("trees_kept"))
        out = row if out is None else out.unionByName(row)
    return out


def assert_reproduces_published(points: Sequence[dict], published: dict, hours: int) -> None:
    """The sweep's row of the configured extension must equal the published operating point."""
    for p in (p for p in points if p["hours"] == hours):
        want = published[f"test/{p['scorer']}"]
        if p["caught"] != want["caught"] or round(p["threshold"], 9) != round(want["threshold"], 9):
            raise SchemaError(f"sweep does not reproduce {p['scorer']}: caught {p['caught']} against {want['caught']}, threshold {p['threshold']} against {want['threshold']}")


def sweep(run: Run, rounds: int | None = None) -> dict:
    params, test = run.params, run.windows[-1]
    asked, configured = params.experiments.pass_through_sweep_hours, params.pass_through_window_hours
    feasible = feasible_hours(test, asked)
    if configured not in feasible:
        raise SchemaError(f"the configured {configured} h are not among the feasible {list(feasible)}: the sweep cannot be checked against the published run")
    rows = records(passthrough_sweep(run.table("canonical_txns"), run.windows, params, params.costs, Scratch(run.spark, "sweep"), rounds=rounds))
    path = run.reports / "metrics_economics.json"
    if path.is_file():
        assert_reproduces_published(rows, read_metrics(path)["operating_point"], configured)
    return run.metrics("sweep", contract.sweep(rows, asked, feasible, test, params))


def brief(run: Run) -> list[dict]:
    params, spec = run.params, run.params.brief
    scores, matrix = run.table("scores"), run.table("features")
    if spec.scorer not in scores.columns:
        raise SchemaError(f"brief scorer {spec.scorer!r} is not a scored column")
    queue = _queues(run, scores).filter((F.col("window") == "test") & (F.col("scorer") == spec.scorer))
    alerted = worklist.select_alerts(worklist.apply_policy(queue, params.costs.queue_overflow_policy, KEYS), [params.costs.analyst_capacity_per_day], KEYS, params.label_window_days)
    test = _of(matrix, "test")
    made = briefs.build_briefs(alerted, test, scoring.population_percentiles(test, briefs.COLUMNS), spec.standout_percentile)
    sampled = records(briefs.sample_briefs(made, spec.sample))
    folder = run.reports / "briefs"
    folder.mkdir(parents=True, exist_ok=True)
    for b in sampled:
        (folder / f"account_{b['account']}.md").write_text(briefs.render(b, spec.scorer), encoding="utf-8")
    index = [f"- [Account {b['account']}](account_{b['account']}.md), alert {b['rank']} of {b['alerts']}" for b in sampled]
    (folder / "README.md").write_text("\n".join(["# Briefs", "", *index, ""]), encoding="utf-8")
    run.metrics("brief", contract.brief(sampled, sampled[0]["alerts"] if sampled else 0, params))
    return sampled


STAGES = {
    "ingest": ingest, "features": features, "models": models, "economics": economics, "monitoring": monitoring, "report": write_report, "figures": figures, "window-scan": window_scan,
    "components": component_stage, "sweep": sweep, "brief": brief,
}
ALL = ("ingest", "features", "models", "economics", "monitoring", "report", "figures")


def main(names: Sequence[str]) -> int:
    logging.basicConfig(level=logging.INFO)
    wanted = ALL if list(names) == ["all"] else names
    if not wanted or any(n not in STAGES for n in wanted):
        print(f"usage: python -m ledgersift.plans.stages all | {' | '.join(STAGES)}")
        return 2
    run = Run(build_session(), load_params())  # the master is spark-submit's; without one Spark runs locally
    for name in wanted:
        LOG.info("stage %s", name)
        STAGES[name](run)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
