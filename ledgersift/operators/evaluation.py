"""How well a score ranks: average precision with ties, the curve, paired bootstrap intervals, and drift."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.config import LABEL, SchemaError
from ledgersift.functions.scalars import psi_reading
from ledgersift.scratch import Scratch
from ledgersift.skew import exact_quantiles, join_per_key, running_totals

GROUP = ["window", "scorer"]


def stacked(matrix: DataFrame, scorers: Sequence[str]) -> DataFrame:
    """``window, account, is_mule, scorer, score`` from one column per scorer."""
    wide = matrix.select("window", "account", LABEL, *[F.col(s).cast("double").alias(s) for s in scorers])
    return wide.unpivot(["window", "account", LABEL], list(scorers), "scorer", "score")


def _by_threshold(scores: DataFrame) -> DataFrame:
    """One row per distinct score: rows and mules there, and at it or above."""
    at = scores.groupBy(*GROUP, "score").agg(F.count("*").alias("n"), F.sum(F.col(LABEL).cast("long")).alias("hits"))
    run = running_totals(at, GROUP, F.desc("score"), {"above": "n", "caught": "hits"}, Scratch(scores.sparkSession, "thresholds"), "thresholds")
    return run.withColumnRenamed("caught_all", "mules")


def average_precision(scores: DataFrame) -> DataFrame:
    """``window, scorer, average_precision``: equal scores are one threshold; null without mules."""
    step = F.try_divide(F.col("caught").cast("double"), F.col("above")) * F.col("hits")
    out = _by_threshold(scores).groupBy(*GROUP).agg(F.sum(step).alias("s"), F.max("mules").alias("mules"))
    return out.select(*GROUP, F.try_divide("s", F.col("mules")).alias("average_precision"))


def pr_curve(scores: DataFrame) -> DataFrame:
    """``window, scorer, threshold, precision, recall`` for each distinct score, and the end point (1, 0) without threshold."""
    points = _by_threshold(scores).select(*GROUP, F.col("score").alias("threshold"), F.try_divide(F.col("caught").cast("double"), F.col("above")).alias("precision"), F.try_divide(F.col("caught").cast("double"), F.col("mules")).alias("recall"))
    ends = scores.select(*GROUP).distinct().select(*GROUP, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(ends)


def pr_table(scores: DataFrame) -> DataFrame:
    """Average precision, base rate and their quotient, per scorer."""
    base = scores.groupBy(*GROUP).agg(F.avg(F.col(LABEL).cast("double")).alias("base_rate"))
    return average_precision(scores).join(base, GROUP).withColumn("lift", F.try_divide("average_precision", "base_rate"))


#: Rows of a window and scorer that one task weighs for all draws.
BLOCK_ROWS = 100_000
#: The chances of a Poisson number of mean 1 being at most 0, 1, 2, ...; beyond the last it would be 13 or more.
POISSON = tuple(sum(exp(-1) / factorial(j) for j in range(k + 1)) for k in range(13))

_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def resample_weights(accounts: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """How often each account (row) is in each draw (column): Poisson numbers of mean 1, hashed from seed, account and draw alone."""
    first, second, third = (np.uint64(c) for c in _ODD)
    with np.errstate(over="ignore"):
        x = accounts.astype(np.int64).view(np.uint64)[:, None] * first + (draws.astype(np.uint64) + np.uint64(seed) * np.uint64(1 << 32))[None, :]
        for shift, factor in ((30, second), (27, third), (31, first), (29, second)):
            x = (x ^ (x >> np.uint64(shift))) * factor
    return np.searchsorted(POISSON, (x >> np.uint64(11)) * 2.0**-53, side="right").astype(np.uint8)


def _weighed(frame: pa.Table, draws: int, seed: int, step: int = 2_000_000) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For some draws at a time: rows and mules in them at each distinct score, from the highest."""
    score, label, account = (frame[c].to_numpy() for c in ("score", "label", "account"))
    order = np.lexsort((account, -score))
    score, label, account = score[order], label[order].astype(bool), account[order]
    begins = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
    wide = max(1, step // len(score))
    for at in range(0, draws, wide):
        w = resample_weights(account, np.arange(at, min(at + wide, draws)), seed).astype(np.int64)
        yield slice(at, at + w.shape[1]), np.add.reduceat(w, begins, axis=0), np.add.reduceat(w * label[:, None], begins, axis=0)


def bootstrap_draws(matrix: DataFrame, scorers: Sequence[str], resamples: int, seed: int, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``window, draw, scorer, average_precision``: accounts resampled with replacement, the same draw for all scorers.

    An account's weight in a draw is a Poisson number of mean 1 from a hash (the bootstrap for data in many parts), so no task needs the population:
    rows are cut into blocks along the score, a block sums its weights for all draws, the sums of the blocks above it come back, and the block adds up its
    part of the average precision. A score that more than ``block_rows`` rows share is a block of its own, summed in parts.
    """
    if resamples < 1:
        raise SchemaError("at least one resample is needed")
    scratch = Scratch(matrix.sparkSession, "bootstrap")
    long = scratch.save(stacked(matrix, scorers).select(*GROUP, "account", F.col(LABEL).cast("int").alias("label"), "score"), "rows")
    counts = long.groupBy(*GROUP, "score").agg(F.count("*").alias("n"))
    run = running_totals(counts, GROUP, F.desc("score"), {"above": "n"}, scratch, "scores")
    per_score = run.select(*GROUP, "score", "n", F.floor((F.col("above") - F.col("n")) / block_rows).alias("block"), (F.col("n") > block_rows).cast("int").alias("one_score"))
    laid = join_per_key(long, scratch.save(per_score, "blocks"), [*GROUP, "score"], "n", long.count())
    part = F.when(F.col("one_score") == 1, F.pmod(F.xxhash64("account"), F.lit(64))).otherwise(0)
    laid = scratch.save(laid.withColumn("part", part.cast("int")), "laid")
    block = [*GROUP, "block", "one_score"]

    def sums(table: pa.Table) -> pa.Table:
        rows, mules = np.zeros(resamples), np.zeros(resamples)
        for at, n, hits in _weighed(table, resamples, seed):
            rows[at], mules[at] = n.sum(axis=0), hits.sum(axis=0)
        return _one(table, [*block, "part"]).append_column("rows", pa.array([rows.tobytes()], pa.binary())).append_column("mules", pa.array([mules.tobytes()], pa.binary()))

    def offsets(table: pa.Table) -> pa.Table:
        """Of one window and scorer: for each block what lies above it, the mules in all, and the part of single scores."""
        table = table.sort_by([("block", "ascending"), ("one_score", "ascending")])
        keys = list(zip(table["block"].to_pylist(), table["one_score"].to_pylist(), strict=True))
        begins = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
        rows, mules = (np.add.reduceat([np.frombuffer(x) for x in table[c].to_pylist()], begins, axis=0) for c in ("rows", "mules"))
        above, caught = np.cumsum(rows, axis=0) - rows, np.cumsum(mules, axis=0) - mules
        own = mules * np.divide(caught + mules, above + rows, out=np.zeros_like(rows), where=above + rows > 0)
        total = mules.sum(axis=0).tobytes()
        out = [_one(table.slice(b, 1), block) for b in begins]
        packed = [("above", above), ("caught", caught), ("own", own)]
        made = pa.concat_tables(out)
        for name, values in packed:
            made = made.append_column(name, pa.array([v.tobytes() for v in values], pa.binary()))
        return made.append_column("total", pa.array([total] * len(begins), pa.binary()))

    def shares(table: pa.Table, known: pa.Table) -> pa.Table:
        """The block's part of each draw's average precision, a row per draw."""
        above, caught, own, total = (np.frombuffer(known[c][0].as_py()) for c in ("above", "caught", "own", "total"))
        part = own.copy() if known["one_score"][0].as_py() else np.zeros(resamples)
        if table.num_rows and not known["one_score"][0].as_py():
            for at, n, hits in _weighed(table, resamples, seed):
                reach, found = np.cumsum(n, axis=0) + above[at], np.cumsum(hits, axis=0) + caught[at]
                part[at] = (hits * np.divide(found, reach, out=np.zeros(reach.shape), where=reach > 0)).sum(axis=0)
        columns = [pa.array([known[c][0].as_py()] * resamples) for c in GROUP]
        return pa.table([*columns, pa.array(np.arange(resamples)), pa.array(part), pa.array(total)], names=[*GROUP, "draw", "part", "total"])

    named = "window string, scorer string, block long, one_score int"
    summed = laid.groupBy(*block, "part").applyInArrow(sums, f"{named}, part int, rows binary, mules binary")
    known = scratch.save(summed.groupBy(*GROUP).applyInArrow(offsets, f"{named}, above binary, caught binary, own binary, total binary"), "offsets")
    plain = laid.filter("one_score = 0")
    made = plain.groupBy(*block).cogroup(known.groupBy(*block)).applyInArrow(shares, "window string, scorer string, draw long, part double, total double")
    return made.groupBy("window", "draw", "scorer").agg(F.try_divide(F.sum("part"), F.max("total")).alias("average_precision"))


def _one(table: pa.Table, names: Sequence[str]) -> pa.Table:
    return table.select(list(names)).slice(0, 1)


def summarise_draws(draws: DataFrame, scores: DataFrame) -> DataFrame:
    """``window, scorer, average_precision, low, high``: the point value and the middle 95 % of the draws."""
    bounds = draws.groupBy(*GROUP).agg(F.percentile("average_precision", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    return average_precision(scores).join(bounds, GROUP, "left").select(*GROUP, "average_precision", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def paired_differences(draws: DataFrame, scores: DataFrame, scorers: Sequence[str]) -> DataFrame:
    """Per window and pair of scorers: difference of the point values, its interval over the draws, and whether that holds zero."""
    point = average_precision(scores).groupBy("window").pivot("scorer", list(scorers)).agg(F.first("average_precision"))
    wide = draws.groupBy("window", "draw").pivot("scorer", list(scorers)).agg(F.first("average_precision"))
    out = None
    for b, a in combinations(scorers, 2):
        gap = wide.groupBy("window").agg(F.percentile(F.col(a) - F.col(b), F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
        part = point.join(gap, "window").select("window", F.lit(a).alias("scorer"), F.lit(b).alias("against"), (F.col(a) - F.col(b)).alias("difference"), F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("crosses_zero", (F.col("low") <= 0) & (F.col("high") >= 0))


# Drift: reference against comparison, long frames (feature, side, value)


def quantile_edges(values: DataFrame, bins: int) -> DataFrame:
    """``feature, edges``: inner edges at the reference's quantiles (linear, repeats kept); the outer ones are infinite."""
    if bins < 2:
        raise SchemaError("at least two bins are needed")
    inner, reference = [i / bins for i in range(1, bins)], values.filter("side = 'reference'")
    found = exact_quantiles(reference, ["feature"], "value", inner, Scratch(values.sparkSession, "edges"), "values")
    return found.withColumnRenamed("quantiles", "edges")


def drift_table(values: DataFrame, *, bins: int, epsilon: float) -> DataFrame:
    """Per feature: PSI with its reading, empty bins, distinct edges, and null shares on both sides.

    A value falls in the bin whose number is the count of inner edges at or below it, so repeated edges leave bins empty rather than fail. An empty
    bin counts as ``epsilon``, after which each side sums to one again.
    """
    if epsilon <= 0:
        raise SchemaError("epsilon must be positive")
    edges = quantile_edges(values, bins)
    shares = values.groupBy("feature").agg(*[F.avg(F.when(F.col("side") == s, F.col("value").isNull().cast("double"))).alias(f"{s}_null_share") for s in ("reference", "comparison")])
    known = values.filter("value is not null").join(F.broadcast(edges), "feature")  # a row per feature
    place = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    # a feature has at most ``bins`` rows here, so its group is small whatever the table's size
    binned = known.groupBy("feature", "edges", place.alias("bin")).agg(F.count_if(F.col("side") == "reference").alias("r"), F.count_if(F.col("side") == "comparison").alias("c"))
    table = binned.groupBy("feature", "edges").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("r", "c")))).alias("m"), F.sum("r").alias("nr"), F.sum("c").alias("nc")).filter("nr > 0 and nc > 0")
    parts = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.struct(
        F.coalesce(F.try_divide(F.try_element_at("m", b)["r"].cast("double"), F.col("nr")), F.lit(0.0)).alias("r"), F.coalesce(F.try_divide(F.try_element_at("m", b)["c"].cast("double"), F.col("nc")), F.lit(0.0)).alias("c"),
    ))
    raised = lambda side: F.transform("parts", lambda p: F.when(p[side] > 0, p[side]).otherwise(F.lit(epsilon)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    shaped = table.withColumn("parts", parts).select(
        "feature", F.size(F.filter("parts", lambda p: (p["r"] == 0) | (p["c"] == 0))).cast("long").alias("empty_bins"),
        (F.size(F.array_distinct("edges")) + 2).cast("long").alias("distinct_reference_edges"), raised("r").alias("r"), raised("c").alias("c"),
    ).withColumns({"tr": total(F.col("r")), "tc": total(F.col("c"))})
    psi = F.aggregate(F.zip_with("r", "c", lambda r, c: (c / F.col("tc") - r / F.col("tr")) * F.ln((c / F.col("tc")) / (r / F.col("tr")))), F.lit(0.0), lambda s, x: s + x)
    return shares.join(shaped.withColumn("psi", psi), "feature", "left").select(
        "feature", "psi", F.coalesce(psi_reading(F.col("psi")), F.lit("undefined, a window has no values")).alias("reading"), "empty_bins", "distinct_reference_edges",
        (F.col("empty_bins") > 0).alias("epsilon_dependent"), "reference_null_share", "comparison_null_share",
    )


def ks_statistic(values: DataFrame) -> DataFrame:
    """``feature, ks``: the largest gap between the two sides' cumulative shares."""
    known = values.filter("value is not null")
    at = known.groupBy("feature", "value").agg(F.count_if(F.col("side") == "reference").alias("r"), F.count_if(F.col("side") == "comparison").alias("c"))
    run = running_totals(at, ["feature"], F.col("value"), {"x": "r", "y": "c"}, Scratch(values.sparkSession, "ks"), "values")
    gap = F.abs(F.try_divide(F.col("x").cast("double"), F.col("x_all")) - F.try_divide(F.col("y").cast("double"), F.col("y_all")))
    return run.select("feature", gap.alias("gap")).groupBy("feature").agg(F.max("gap").alias("ks"))


def long_values(matrix: DataFrame, columns: Sequence[str], reference: str, comparison: str) -> DataFrame:
    """``feature, side, value`` of two windows."""
    if missing := [c for c in columns if c not in matrix.columns]:
        raise SchemaError(f"columns missing: {missing}")
    side = F.when(F.col("window") == reference, "reference").otherwise("comparison")
    two = matrix.filter(F.col("window").isin(reference, comparison)).select(side.alias("side"), *[F.col(c).cast("double").alias(c) for c in columns])
    return two.unpivot(["side"], list(columns), "feature", "value")
