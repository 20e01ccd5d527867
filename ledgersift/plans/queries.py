"""The registered analytics queries: thin plans over the operators, rounded for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersift.operators import briefs, evaluation, flows, graph, population, scoring, worklist
from ledgersift.operators.evaluation import long_values, stacked
from ledgersift.plans import study
from ledgersift.plans.figures import funnel_stages
from ledgersift.plans.features import build_features, history_scan, relational_features
from ledgersift.plans.study import COSTS, DAYS, HISTORIES, HOURS, KEYS, PARAMS, RATIOS, TRADE_HOURS, TRADE_WINDOWS, VOLUMES, WINDOWS
from ledgersift.scratch import Scratch
from ledgersift.sources.ledger import codebook, normalise, observed_span, trade_ledger

QUERIES: dict = {}
TEST = WINDOWS[-1:]
DRIFT_COLUMNS = [c for c in scoring.FEATURES if c != "pagerank"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, counts as long: what is compared does not depend on summation order."""
    out = []
    for name, kind in df.dtypes:
        if kind == "double":
            out.append(F.round(name, digits).alias(name))
        elif kind in ("int", "tinyint", "smallint"):
            out.append(F.col(name).cast("long").alias(name))
        elif kind.startswith("decimal"):
            out.append(F.round(F.col(name).cast("double"), digits).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


@query
def fx_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(normalise(study.raw(spark, sf_dir), PARAMS.fx_to_base).select("row_id", "base_received", "base_paid"))


@query
def self_transfer_audit(spark, sf_dir):
    own = F.col("account_from") == F.col("account_to")
    return study.raw(spark, sf_dir).agg(F.count("*").alias("rows"), F.count_if(own).alias("self_transfers"), F.count_if(F.col("is_laundering") == 1).alias("laundering_rows"), F.count_if(own & (F.col("is_laundering") == 1)).alias("laundering_dropped"))


@query
def contract_counts(spark, sf_dir):
    accounts = study.raw(spark, sf_dir).select(F.explode(F.array("account_from", "account_to")).alias("account")).distinct().agg(F.count("*").alias("accounts"))
    return self_transfer_audit(spark, sf_dir).join(accounts, how="cross").select("rows", "accounts", "self_transfers", "laundering_rows")


@query
def account_codebook(spark, sf_dir):
    key = lambda c: F.concat_ws("|", F.lit("1"), F.col(c).cast("string"))
    rows = study.raw(spark, sf_dir).select("row_id", key("account_from").alias("key_from"), key("account_to").alias("key_to"))
    return codebook(rows, Scratch(spark, "codebook"))


@query
def ledger_span(spark, sf_dir):
    return observed_span(study.raw(spark, sf_dir).filter("account_from <> account_to"))


@query
def leakage_cut(spark, sf_dir):
    return population.before(study.ledger(spark, sf_dir), WINDOWS[1].feature_end).agg(F.count("*").alias("rows"), F.max("ts").alias("last_ts"))


@query
def account_flows(spark, sf_dir):
    return _round(population.account_flows(study.ledger(spark, sf_dir)))


@query
def daily_volume(spark, sf_dir):
    return _round(population.daily_volume(study.raw(spark, sf_dir).filter("account_from <> account_to")))


@query
def population_by_window(spark, sf_dir):
    return population.population(study.ledger(spark, sf_dir), WINDOWS)


@query
def labels_by_window(spark, sf_dir):
    return _round(population.labels(study.ledger(spark, sf_dir), WINDOWS))


@query
def unscoreable_by_window(spark, sf_dir):
    return population.unscoreable(study.ledger(spark, sf_dir), WINDOWS)


@query
def window_summary(spark, sf_dir):
    return _round(population.window_summary(study.ledger(spark, sf_dir), WINDOWS))


@query
def daily_candidates(spark, sf_dir):
    return population.daily_candidates(study.ledger(spark, sf_dir), WINDOWS)


def _directional(spark, sf_dir):
    return relational_features(study.ledger(spark, sf_dir), WINDOWS, PARAMS.features, HOURS)


@query
def directional_in(spark, sf_dir):
    return _round(_directional(spark, sf_dir).select("window", "account", "in_degree", "unique_counterparties_in", "total_inflow", "max_inflow", "inflow_concentration"))


@query
def directional_out(spark, sf_dir):
    return _round(_directional(spark, sf_dir).select("window", "account", "out_degree", "unique_counterparties_out", "total_outflow", "max_outflow", "outflow_concentration"))


@query
def activity(spark, sf_dir):
    return _round(_directional(spark, sf_dir).select("window", "account", "active_days", "burstiness"))


@query
def pass_through_ratio(spark, sf_dir):
    return _round(_directional(spark, sf_dir).select("window", "account", "pass_through_ratio"))


@query
def median_hours_to_outflow(spark, sf_dir):
    return _round(_directional(spark, sf_dir).select("window", "account", "median_hours_to_outflow"))


@query
def asymmetries(spark, sf_dir):
    return _round(_directional(spark, sf_dir).select("window", "account", "degree_asymmetry", "counterparty_asymmetry", "sender_diversity", "mean_amount_ratio"))


@query
def reciprocity(spark, sf_dir):
    return _round(_directional(spark, sf_dir).select("window", "account", "reciprocity"))


@query
def feature_matrix(spark, sf_dir):
    return _round(_directional(spark, sf_dir))


@query
def fifo_pairs(spark, sf_dir):
    pairs = flows.fifo_pairs(flows.legs(study.ledger(spark, sf_dir), WINDOWS, HOURS))
    return _round(pairs.groupBy("window", "account", F.round("latency_hours", 6).alias("latency_hours")).agg(F.sum("weight").alias("weight")))


@query
def fifo_latency(spark, sf_dir):
    return _round(flows.fifo_latency(flows.legs(study.ledger(spark, sf_dir), WINDOWS, HOURS)))


@query
def null_rates(spark, sf_dir):
    return _round(scoring.null_rates(_directional(spark, sf_dir)))


@query
def log1p_features(spark, sf_dir):
    columns = [c for c in PARAMS.logistic.log1p_features if c != "pagerank"]
    return _round(scoring.log1p_features(_directional(spark, sf_dir), columns).select("window", "account", *columns))


@query
def rules_flag(spark, sf_dir):
    return scoring.rules_flag(study.matrix(spark, sf_dir), PARAMS.rules).select("window", "account", "rules_flag")


@query
def matched_rules_flag(spark, sf_dir):
    return scoring.matched_rules_flag(study.matrix(spark, sf_dir), 0.9).select("window", "account", "matched_rules_flag")


@query
def rules_diagnostics(spark, sf_dir):
    return _round(scoring.rules_diagnostics(study.matrix(spark, sf_dir), PARAMS.rules))


@query
def rules_score(spark, sf_dir):
    return _round(study.scored(spark, sf_dir).select("window", "account", "rules"), 9)


@query
def flag_summary(spark, sf_dir):
    return _round(scoring.flag_summary(scoring.matched_rules_flag(study.matrix(spark, sf_dir), 0.9), "matched_rules_flag"))


@query
def population_percentiles(spark, sf_dir):
    return _round(scoring.population_percentiles(_directional(spark, sf_dir), briefs.COLUMNS), 9)


@query
def candidate_queue(spark, sf_dir):
    return _round(study.checked_queue(spark, sf_dir))


def _alerts(spark, sf_dir, windows=None):
    rows = study.queue(spark, sf_dir)
    rows = rows.filter(F.col("window").isin(windows)) if windows else rows
    return worklist.select_alerts(worklist.apply_policy(rows, COSTS.queue_overflow_policy, KEYS), [COSTS.analyst_capacity_per_day], KEYS, DAYS)


@query
def select_alerts(spark, sf_dir):
    return _round(_alerts(spark, sf_dir))


@query
def overflow_queue(spark, sf_dir):
    return _round(worklist.apply_policy(study.queue(spark, sf_dir), "rollover_max_3d", KEYS))


@query
def operating_point(spark, sf_dir):
    return _round(worklist.evaluate(study.queue(spark, sf_dir), COSTS, KEYS, DAYS))


@query
def operating_context(spark, sf_dir):
    rows = study.queue(spark, sf_dir)
    lost = population.window_summary(study.ledger(spark, sf_dir), WINDOWS).select("window", "unscoreable_mules")
    return _round(worklist.against_chance(worklist.evaluate(rows, COSTS, KEYS, DAYS), worklist.exposure_concentration(rows, COSTS, KEYS), lost))


@query
def coverage_curve(spark, sf_dir):
    return _round(worklist.coverage_curve(study.queue(spark, sf_dir), VOLUMES, KEYS, DAYS))


@query
def volume_curve(spark, sf_dir):
    return _round(worklist.priced(worklist.coverage_curve(study.queue(spark, sf_dir), VOLUMES, KEYS, DAYS), COSTS))


@query
def volume_optimum(spark, sf_dir):
    return _round(worklist.volume_optimum(worklist.priced(worklist.coverage_curve(study.queue(spark, sf_dir), VOLUMES, KEYS, DAYS), COSTS), KEYS))


@query
def sensitivity(spark, sf_dir):
    return _round(worklist.sensitivity(study.queue(spark, sf_dir), COSTS, PARAMS.multipliers, KEYS, DAYS))


def _break_even(spark, sf_dir):
    return worklist.break_even_curve(study.queue(spark, sf_dir), COSTS, RATIOS, VOLUMES, KEYS, DAYS)


@query
def break_even_curve(spark, sf_dir):
    return _round(_break_even(spark, sf_dir))


@query
def crossing_ratio(spark, sf_dir):
    return _round(worklist.crossing_ratio(_break_even(spark, sf_dir), COSTS.analyst_capacity_per_day, KEYS))


@query
def overflow_comparison(spark, sf_dir):
    return _round(worklist.overflow_comparison(study.queue(spark, sf_dir), COSTS, DAYS))


@query
def overflow_verdict(spark, sf_dir):
    return _round(worklist.overflow_verdict(worklist.overflow_comparison(study.queue(spark, sf_dir), COSTS, DAYS), COSTS.queue_overflow_policy))


@query
def exposure_concentration(spark, sf_dir):
    return _round(worklist.exposure_concentration(study.queue(spark, sf_dir), COSTS, KEYS))


@query
def reachability_funnel(spark, sf_dir):
    missing = population.unscoreable(study.ledger(spark, sf_dir), WINDOWS[1:])
    return _round(funnel_stages(study.queue(spark, sf_dir), missing, _alerts(spark, sf_dir)))


def _edges(spark, sf_dir, windows=WINDOWS):
    return graph.edges(study.ledger(spark, sf_dir), windows)


@query
def graph_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query
def graph_degrees(spark, sf_dir):
    return _round(graph.degrees(_edges(spark, sf_dir)))


@query
def triangles(spark, sf_dir):
    return _round(graph.triangles(_edges(spark, sf_dir)))


@query
def graph_stats(spark, sf_dir):
    return _round(graph.graph_stats(_edges(spark, sf_dir)))


@query
def pagerank(spark, sf_dir):
    spec = PARAMS.features
    ranks = graph.pagerank(_edges(spark, sf_dir), Scratch(spark, "pagerank"), damping=spec.pagerank_damping, max_iter=spec.pagerank_max_iter, tol=spec.pagerank_tol)
    return _round(ranks, 9)


@query
def full_feature_matrix(spark, sf_dir):
    """All twenty features, label and exposure, as the stage builds them."""
    return _round(build_features(study.ledger(spark, sf_dir), WINDOWS, PARAMS.features, HOURS, Scratch(spark, "features")))


@query
def null_guard(spark, sf_dir):
    """Nulls by feature, and whether the guard lets them pass."""
    counts = scoring.null_counts(_directional(spark, sf_dir))
    rows = [(c, n, not n or c in scoring.NULLABLE) for c, n in counts.items()]
    return spark.createDataFrame(rows, "feature string, nulls long, passes boolean")


@query
def class_weight(spark, sf_dir):
    weight, n = scoring.scale_pos_weight(study.matrix(spark, sf_dir).filter("window = 'train'"), counted=True)
    return _round(spark.createDataFrame([(n, weight)], "accounts long, weight double"))


@query
def volume_grid(spark, sf_dir):
    """The whole queue's grid of daily volumes."""
    from ledgersift.plans.stages import volume_grid as grid

    ceiling = study.queue(spark, sf_dir).groupBy(*KEYS, "day").count().agg(F.max("count")).first()[0] or 1
    return spark.createDataFrame([(k,) for k in grid(ceiling, 60, COSTS.analyst_capacity_per_day)], "k long")


@query
def logistic_fixed_scores(spark, sf_dir):
    scored = study.FIXED_MODEL.score(_directional(spark, sf_dir))
    return scored.select("window", "account", F.round("logistic", 8).alias("logistic"))


def _components(spark, sf_dir):
    rows = _edges(spark, sf_dir, TEST)
    return rows, graph.components(rows, Scratch(spark, "components"))


@query
def components(spark, sf_dir):
    return _components(spark, sf_dir)[1]


@query
def component_profile(spark, sf_dir):
    return _round(graph.component_profile(graph.component_table(*_components(spark, sf_dir))))


@query
def component_bands(spark, sf_dir):
    rows, named = _components(spark, sf_dir)
    accounts = population.population(study.ledger(spark, sf_dir), TEST).select("account")
    return _round(graph.band_table(graph.account_component_sizes(accounts, named, graph.component_table(rows, named)), "population"))


@query
def history_scan_query(spark, sf_dir):
    return _round(history_scan(study.ledger(spark, sf_dir), HISTORIES))


def _stacked(spark, sf_dir):
    base = study.scored(spark, sf_dir).withColumn("exposure_rank", F.round("exposure", 2))
    return stacked(base, ["rules", "exposure_rank"])


@query
def average_precision(spark, sf_dir):
    return _round(evaluation.average_precision(_stacked(spark, sf_dir)))


@query
def pr_curve(spark, sf_dir):
    return _round(evaluation.pr_curve(_stacked(spark, sf_dir).filter("scorer = 'rules'")))


@query
def pr_table(spark, sf_dir):
    return _round(evaluation.pr_table(_stacked(spark, sf_dir)))


@query
def psi_features(spark, sf_dir):
    rounded = _directional(spark, sf_dir).select("window", *[F.round(c, 6).alias(c) for c in DRIFT_COLUMNS])
    spec = PARAMS.monitoring
    return _round(evaluation.drift_table(long_values(rounded, DRIFT_COLUMNS, "train", "test"), bins=spec.bins, epsilon=spec.epsilon), 5)


@query
def psi_scores(spark, sf_dir):
    rounded = study.scored(spark, sf_dir).select("window", F.round("rules", 9).alias("rules"))
    spec = PARAMS.monitoring
    return _round(evaluation.drift_table(long_values(rounded, ["rules"], "train", "test"), bins=spec.bins, epsilon=spec.epsilon), 5)


@query
def ks_scores(spark, sf_dir):
    rounded = study.scored(spark, sf_dir).select("window", F.round("rules", 9).alias("rules"))
    return _round(evaluation.ks_statistic(long_values(rounded, ["rules"], "train", "test")))


@query
def briefs_table(spark, sf_dir):
    matrix = _directional(spark, sf_dir)
    made = briefs.build_briefs(_alerts(spark, sf_dir, ["test"]), matrix, scoring.population_percentiles(matrix, briefs.COLUMNS), PARAMS.brief.standout_percentile)
    return _round(made.select("window", "account", "rank", "alerts", "score", "exposure", "is_mule", F.size("standouts").cast("long").alias("n_standouts"), "next_step"))


@query
def brief_texts(spark, sf_dir):
    matrix = _directional(spark, sf_dir)
    made = briefs.build_briefs(_alerts(spark, sf_dir, ["test"]), matrix, scoring.population_percentiles(matrix, briefs.COLUMNS), PARAMS.brief.standout_percentile)
    told = made.withColumn("standouts", F.array_join("standouts", "; "))
    return _round(briefs.sample_briefs(told, PARAMS.brief.sample))


@query
def brief_phrases(spark, sf_dir):
    """What every alerted account's brief says."""
    matrix = _directional(spark, sf_dir)
    made = briefs.build_briefs(_alerts(spark, sf_dir, ["test"]), matrix, scoring.population_percentiles(matrix, briefs.COLUMNS), 0.6)
    return made.select("window", "account", F.array_join("standouts", "; ").alias("standouts"), "next_step")


def _trade(spark, sf_dir):
    return normalise(trade_ledger(spark, sf_dir).filter("account_from <> account_to"), PARAMS.fx_to_base, checked=False)


@query
def trade_account_flows(spark, sf_dir):
    return _round(population.account_flows(_trade(spark, sf_dir)), 5)


@query
def trade_daily_volume(spark, sf_dir):
    return _round(population.daily_volume(_trade(spark, sf_dir)))


@query
def trade_feature_matrix(spark, sf_dir):
    return _round(relational_features(_trade(spark, sf_dir), TRADE_WINDOWS, PARAMS.features, TRADE_HOURS), 5)


@query
def trade_graph_stats(spark, sf_dir):
    return _round(graph.graph_stats(graph.edges(_trade(spark, sf_dir), TRADE_WINDOWS)))


# Trained models and resampling: no SQL, tested by their properties


def _full(spark, sf_dir):
    scratch = Scratch(spark, "models")
    return scratch.save(build_features(study.ledger(spark, sf_dir), WINDOWS, PARAMS.features, HOURS, scratch), "matrix")


def _side(matrix, name):
    return matrix.filter(F.col("window") == name)


@query
def logistic_scores(spark, sf_dir):
    matrix = _full(spark, sf_dir)
    model = scoring.fit_logistic(_side(matrix, "train"), PARAMS.logistic, PARAMS.seed)
    return model.score(matrix).select("window", "account", F.round("logistic", 6).alias("logistic"))


def _trees(matrix, rounds=12):
    return scoring.fit_trees(_side(matrix, "train"), _side(matrix, "val"), PARAMS.model, PARAMS.seed, rounds)


@query
def gbt_scores(spark, sf_dir):
    matrix = _full(spark, sf_dir)
    return _trees(matrix).score(matrix).select("window", "account", F.round("xgboost", 6).alias("xgboost"))


@query
def gbt_importance(spark, sf_dir):
    found = _trees(_full(spark, sf_dir)).importance()
    return spark.createDataFrame([(c, round(v, 9)) for c, v in found], "feature string, importance double")


def _draws(spark, sf_dir):
    base = study.scored(spark, sf_dir).withColumn("exposure_rank", F.round("exposure", 2)).filter("window <> 'train'")
    base = Scratch(spark, "resampled").save(base, "scored")
    scorers = ["rules", "exposure_rank"]
    return evaluation.bootstrap_draws(base, scorers, PARAMS.bootstrap_resamples, PARAMS.seed), stacked(base, scorers), scorers


@query
def bootstrap_draws(spark, sf_dir):
    return _round(_draws(spark, sf_dir)[0])


@query
def bootstrap_intervals(spark, sf_dir):
    draws, long, _ = _draws(spark, sf_dir)
    return _round(evaluation.summarise_draws(draws, long))


@query
def paired_differences(spark, sf_dir):
    return _round(evaluation.paired_differences(*_draws(spark, sf_dir)))


@query
def passthrough_sweep(spark, sf_dir):
    from ledgersift.plans.stages import passthrough_sweep as sweep

    return _round(sweep(study.ledger(spark, sf_dir), WINDOWS, PARAMS, COSTS, Scratch(spark, "sweep"), scorers=("rules", "logistic")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who to open on each day of the test window under the budget."""
    return _round(_alerts(spark, sf_dir, ["test"])).orderBy("day", F.desc("score"), "account")
