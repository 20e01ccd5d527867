"""The settings and inputs of the registered queries: the test tables' ledger with windows of the shipped shape."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersift.config import Costs, SplitSpec, Window, build_windows, load_params, rehistory
from ledgersift.operators import population, scoring, worklist
from ledgersift.plans.features import relational_features
from ledgersift.scratch import Scratch
from ledgersift.sources.ledger import events_ledger, normalise, usable_span

PARAMS = load_params()
SPLIT = SplitSpec(datetime(2024, 1, 1), datetime(2024, 1, 11), 4)
WINDOWS = build_windows(SPLIT, 2)
HOURS = PARAMS.pass_through_window_hours
DAYS = PARAMS.label_window_days
COSTS: Costs = replace(PARAMS.costs, analyst_capacity_per_day=20)
VOLUMES = (0, 1, 2, 5, 10, 20, 50, 100, 200, 2_000, 20_000)
RATIOS = (0.001, 0.1, 1.0, 5.0, 11.5, 50.0, 1000.0)
HISTORIES: tuple[Window, ...] = tuple(rehistory(WINDOWS[-1], d, SPLIT.data_start) for d in PARAMS.experiments.history_window_days)
KEYS = ["window", "scorer"]
#: Longer windows for the larger trade ledger.
TRADE_WINDOWS = build_windows(SplitSpec(datetime(1996, 1, 1), datetime(1998, 7, 1), 360), 180)
TRADE_HOURS = 720


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_ledger(spark, sf_dir)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable payments in base currency, without self-transfers."""
    txns = raw(spark, sf_dir).filter("account_from <> account_to")
    return usable_span(normalise(txns, PARAMS.fx_to_base, checked=False), SPLIT.data_start, SPLIT.data_end)


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features but PageRank, with label and exposure."""
    txns = ledger(spark, sf_dir)
    return relational_features(txns, WINDOWS, PARAMS.features, HOURS).join(population.labels(txns, WINDOWS), ["window", "account"])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = matrix(spark, sf_dir).select("window", "account", "in_degree", "pass_through_ratio", "is_mule", "exposure")
    once = Scratch(spark, "scored").save(narrow, "matrix")  # read three times
    return scoring.rules_score(once).select("window", "account", "rules", "is_mule", "exposure")


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw queue of the later windows under the rule's score, written once: sweeps read it many times."""
    later = WINDOWS[1:]
    txns = ledger(spark, sf_dir)
    both = scored(spark, sf_dir).filter(F.col("window").isin([w.name for w in later]))
    joined = population.daily_candidates(txns, later).join(both, ["window", "account"])
    rows = joined.select("window", F.lit("rules").alias("scorer"), "account", "day", F.col("rules").alias("score"), "is_mule", "exposure")
    return Scratch(spark, "queue").save(rows, "queue")


def checked_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same queue with its integrity checks."""
    later = WINDOWS[1:]
    both = scored(spark, sf_dir).filter(F.col("window").isin([w.name for w in later]))
    return worklist.build_candidates(population.daily_candidates(ledger(spark, sf_dir), later), both, ["rules"])


#: A fixed scoring model (median, mean, deviation, weight by column): scoring is compared with SQL apart from fitting.
FIXED_MODEL = scoring.Logistic(
    {
        "in_degree": (1.1, 1.2, 0.5, 0.8), "total_inflow": (6.0, 5.5, 1.5, -0.3), "pass_through_ratio": (0.4, 0.5, 0.3, 0.6), "median_hours_to_outflow": (2.0, 2.1, 0.9, -0.2),
        "sender_diversity": (1.0, 0.9, 0.1, 0.1), "mean_amount_ratio": (0.7, 0.8, 0.4, 0.25), "burstiness": (0.5, 0.55, 0.2, -0.4), "reciprocity": (0.0, 0.01, 0.05, 0.15),
    },
    -0.35, tuple(PARAMS.logistic.log1p_features[i] for i in (0, 2, 10, 11, 12)),
)
