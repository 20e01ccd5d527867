"""The feature matrix: all windows in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.config import FeatureSpec, Window
from ledgersift.functions.scalars import asymmetry, ratio
from ledgersift.operators import flows, graph, population
from ledgersift.operators.scoring import FEATURES
from ledgersift.scratch import Scratch

KEY = ["window", "account"]


def relational_features(txns: DataFrame, windows: Sequence[Window], spec: FeatureSpec, hours: int) -> DataFrame:
    """Every feature but PageRank, for exactly the population: the accounts with a payment received, so no join is needed to find it."""
    legs = flows.legs(txns, windows, hours)
    both = flows.pass_through(flows.directional(flows.pair_totals(legs)), spec.min_flow_eur)
    out = both.filter("in_degree > 0").join(flows.activity(legs), KEY, "left").join(flows.hours_to_outflow(legs), KEY, "left")
    mean_out, mean_in = ratio(F.col("total_outflow"), F.col("out_degree")), ratio(F.col("total_inflow"), F.col("in_degree"))
    out = out.withColumns({
        "degree_asymmetry": asymmetry(F.col("in_degree"), F.col("out_degree")),
        "counterparty_asymmetry": asymmetry(F.col("unique_counterparties_in"), F.col("unique_counterparties_out")),
        "sender_diversity": ratio(F.col("unique_counterparties_in"), F.col("in_degree")),
        "mean_amount_ratio": F.try_divide(mean_out, mean_in),
    })
    return out.select(*KEY, *[F.col(c).cast("double").alias(c) for c in FEATURES if c != "pagerank"])


def build_features(txns: DataFrame, windows: Sequence[Window], spec: FeatureSpec, hours: int, scratch: Scratch, *, n_iter: int | None = None) -> DataFrame:
    """``window, account``, the twenty features, ``is_mule`` and ``exposure``."""
    ranks = graph.pagerank(graph.edges(txns, windows), scratch, damping=spec.pagerank_damping, max_iter=spec.pagerank_max_iter, tol=spec.pagerank_tol, n_iter=n_iter)
    plain = relational_features(txns, windows, spec, hours)
    joined = plain.join(ranks.withColumnRenamed("node", "account"), KEY, "left").fillna(0.0, ["pagerank"])
    return joined.join(population.labels(txns, windows), KEY).select(*KEY, *FEATURES, "is_mule", "exposure")


def history_scan(txns: DataFrame, histories: Sequence[Window]) -> DataFrame:
    """For each history length before one label window: population, reach and graph. All lengths in one plan."""
    return population.window_summary(txns, histories).join(graph.graph_stats(graph.edges(txns, histories)), "window")
