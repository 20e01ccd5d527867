"""Scores of the population: the percentile rule, logistic regression, boosted trees."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.config import LABEL, LogisticSpec, RulesBaseline, SchemaError, TreeSpec
from ledgersift.operators.evaluation import average_precision, stacked
from ledgersift.scratch import Scratch
from ledgersift.skew import exact_quantiles, running_totals

#: The feature matrix's columns, in order.
FEATURES = (
    "in_degree", "unique_counterparties_in", "total_inflow", "max_inflow", "inflow_concentration", "out_degree", "unique_counterparties_out", "total_outflow", "max_outflow",
    "outflow_concentration", "pagerank", "reciprocity", "active_days", "burstiness", "pass_through_ratio", "median_hours_to_outflow", "degree_asymmetry", "counterparty_asymmetry",
    "sender_diversity", "mean_amount_ratio",
)
#: Boosting begins with so many rounds more than it waits for a better one.
FIRST_ROUNDS = 10
#: Those that may be null.
NULLABLE = ("pass_through_ratio", "sender_diversity", "mean_amount_ratio", "median_hours_to_outflow")


def feature_columns(matrix: DataFrame) -> list[str]:
    return [c for c in matrix.columns if c in FEATURES]


def null_counts(matrix: DataFrame) -> dict[str, int]:
    columns = feature_columns(matrix)
    got = matrix.agg(*[F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in columns]).first()
    return {c: got[c] for c in columns}


def assert_no_unexpected_nulls(matrix: DataFrame) -> None:
    wrong = {c: n for c, n in null_counts(matrix).items() if n and c not in NULLABLE}
    if wrong:
        raise SchemaError(f"features that must be defined hold nulls: {wrong}")


def null_rates(matrix: DataFrame, by: Sequence[str] = ("window",)) -> DataFrame:
    """``by..., feature, null_rate`` of the features that have any null."""
    columns = feature_columns(matrix)
    rates = matrix.groupBy(*by).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return rates.unpivot(list(by), columns, "feature", "null_rate").filter("null_rate > 0")


def refuse_negative(matrix: DataFrame, columns: Sequence[str]) -> None:
    """Raise if a column declared heavy-tailed is missing or holds a negative value."""
    if missing := [c for c in columns if c not in matrix.columns]:
        raise SchemaError(f"declared for log1p but not a feature: {missing}")
    least = matrix.agg(*[F.min(c).alias(c) for c in columns]).first() if columns else {}
    if negative := [c for c in columns if least[c] is not None and least[c] < 0]:
        raise SchemaError(f"log1p of negative values: {negative}")


def log1p_features(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Declared heavy-tailed columns as log(1 + x); null stays null, negative values are refused."""
    refuse_negative(matrix, columns)
    return matrix.withColumns({c: F.log1p(c) for c in columns}) if columns else matrix


def _cuts(matrix: DataFrame, named: dict[str, tuple[str, float]]) -> DataFrame:
    """``window`` and, under each name, the exact quantile of a column over its window's defined values: a row per window."""
    columns, shares = sorted({c for c, _ in named.values()}), sorted({p for _, p in named.values()})
    values = matrix.select("window", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["window"], columns, "feature", "value")
    found = exact_quantiles(values, ["window", "feature"], "value", shares, Scratch(matrix.sparkSession, "cuts"), "values")
    return found.groupBy("window").agg(*[F.max(F.when(F.col("feature") == c, F.col("quantiles")[shares.index(p)])).alias(n) for n, (c, p) in named.items()])


def rules_flag(matrix: DataFrame, rules: RulesBaseline) -> DataFrame:
    """``rules_flag``: in-degree over its window's percentile and pass-through over a floor; undefined is never flagged."""
    cuts = _cuts(matrix, {"__cut": ("in_degree", rules.in_degree_percentile)})
    flag = (F.col("in_degree") > F.col("__cut")) & F.coalesce(F.col("pass_through_ratio") > rules.pass_through_ratio_min, F.lit(False))
    return matrix.join(F.broadcast(cuts), "window").withColumn("rules_flag", flag).drop("__cut")  # a row per window


def matched_rules_flag(matrix: DataFrame, percentile: float) -> DataFrame:
    """``matched_rules_flag``: both conditions cut at one percentile, the ratio's over its defined values."""
    cuts = _cuts(matrix, {"__a": ("in_degree", percentile), "__b": ("pass_through_ratio", percentile)})
    flag = (F.col("in_degree") > F.col("__a")) & F.coalesce(F.col("pass_through_ratio") > F.col("__b"), F.lit(False))
    return matrix.join(F.broadcast(cuts), "window").withColumn("matched_rules_flag", flag).drop("__a", "__b")


def _share_at_or_below(matrix: DataFrame, column: str, name: str) -> DataFrame:
    """``column``'s distinct values with the share of the window's rows at or below each; null ranks lowest.

    Works on distinct values, so equal values cost one row.
    """
    counts = matrix.groupBy("window", column).agg(F.count("*").alias("n"))
    run = running_totals(counts, ["window"], F.col(column).asc_nulls_first(), {"upto": "n"}, Scratch(matrix.sparkSession, "ranks"), name)
    return run.select("window", column, (F.col("upto") / F.col("upto_all")).alias(name))


def rules_score(matrix: DataFrame) -> DataFrame:
    """``rules``: the lower of the two percentile ranks (ties take the highest rank, undefined the lowest)."""
    out = matrix
    for column, name in (("in_degree", "__x"), ("pass_through_ratio", "__y")):
        ranked = _share_at_or_below(matrix, column, name).withColumnRenamed("window", "__w").withColumnRenamed(column, "__v")
        out = out.join(ranked, (out["window"] == F.col("__w")) & out[column].eqNullSafe(F.col("__v"))).drop("__w", "__v")
    return out.withColumn("rules", F.least("__x", "__y")).drop("__x", "__y")


def flag_summary(matrix: DataFrame, flag: str) -> DataFrame:
    """Per window: flagged accounts, their share, mules among them, mules in all, precision (0 if none)."""
    caught = F.col(flag) & (F.col(LABEL) == 1)
    return matrix.groupBy("window").agg(
        F.count_if(F.col(flag)).alias("flagged"), F.avg(F.col(flag).cast("double")).alias("share"), F.count_if(caught).alias("mules_caught"), F.count_if(F.col(LABEL) == 1).alias("mules"),
        F.coalesce(F.try_divide(F.count_if(caught).cast("double"), F.count_if(F.col(flag))), F.lit(0.0)).alias("precision"),
    )


def rules_diagnostics(matrix: DataFrame, rules: RulesBaseline) -> DataFrame:
    """Per window: how far each condition of the rule goes alone and together, the in-degree cut, and the ratio's 99th percentile."""
    cuts = _cuts(matrix, {"in_degree_cut": ("in_degree", rules.in_degree_percentile), "ratio_p99": ("pass_through_ratio", 0.99)})
    busy, passing = F.col("in_degree") > F.col("in_degree_cut"), F.coalesce(F.col("pass_through_ratio") > rules.pass_through_ratio_min, F.lit(False))
    return matrix.join(F.broadcast(cuts), "window").groupBy("window").agg(
        F.first("in_degree_cut").alias("in_degree_cut"), F.first("ratio_p99").alias("ratio_p99"), F.count_if(busy).alias("busy"), F.count_if(passing).alias("passing"),
        F.count_if(busy & passing).alias("both"), F.count_if(F.col("pass_through_ratio").isNull()).alias("undefined_ratio"),
    )


def scale_pos_weight(matrix: DataFrame, *, counted: bool = False) -> float | tuple[float, int]:
    """Clean accounts per mule; with ``counted`` also the accounts."""
    got = matrix.agg(F.count_if(F.col(LABEL) == 1).alias("p"), F.count_if(F.col(LABEL) == 0).alias("n")).first()
    if not got["p"]:
        raise SchemaError("the training window has no mule: nothing to fit")
    weight = got["n"] / got["p"]
    return (weight, got["n"] + got["p"]) if counted else weight


def population_percentiles(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``window, account, pct_<column>...``: average rank as a share of the defined values; null stays null."""
    long = matrix.select("window", "account", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["window", "account"], list(columns), "feature", "value")
    counts = long.filter("value is not null").groupBy("window", "feature", "value").agg(F.count("*").alias("n"))
    run = running_totals(counts, ["window", "feature"], F.col("value"), {"upto": "n"}, Scratch(matrix.sparkSession, "ranks"), "percentiles")
    ranked = run.select("window", "feature", "value", ((F.col("upto") - F.col("n") + (F.col("n") + 1) / 2) / F.col("upto_all")).alias("pct"))
    wide = long.join(ranked, ["window", "feature", "value"], "left").groupBy("window", "account").pivot("feature", list(columns)).agg(F.first("pct"))
    return wide.select("window", "account", *[F.col(c).alias(f"pct_{c}") for c in columns])


@dataclass(frozen=True)
class Logistic:
    """Median fill, standardisation and a balanced L2 logistic regression, all fitted on the training window: per column (median, mean, deviation, weight)."""

    terms: dict[str, tuple[float, float, float, float]]
    intercept: float
    log1p_features: tuple[str, ...]

    def score(self, matrix: DataFrame, out: str = "logistic") -> DataFrame:
        """``matrix`` with the probability of a mule: one expression, no join."""
        refuse_negative(matrix, self.log1p_features)
        margin = F.lit(self.intercept)
        for column, (median, mean, deviation, weight) in self.terms.items():
            value = F.log1p(column) if column in self.log1p_features else F.col(column).cast("double")
            margin = margin + (F.coalesce(value, F.lit(median)) - mean) / (deviation or 1.0) * weight
        return matrix.withColumn(out, 1 / (1 + F.exp(-margin)))


def fit_logistic(train: DataFrame, spec: LogisticSpec, seed: int = 42) -> Logistic:
    columns = feature_columns(train)
    logged = log1p_features(train, spec.log1p_features)
    long = logged.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "value")
    middle = exact_quantiles(long, ["feature"], "value", [0.5], Scratch(train.sparkSession, "medians"), "values")
    medians = {c: 0.0 for c in columns} | {r["feature"]: r["quantiles"][0] for r in middle.collect()}  # a row per feature
    weight, n = scale_pos_weight(train, counted=True)
    positives = n / (1 + weight)
    balanced = F.when(F.col(LABEL) == 1, n / (2 * positives)).otherwise(n / (2 * (n - positives)))
    ready = logged.fillna(medians).withColumns({"__weight": balanced, "__label": F.col(LABEL).cast("double")})
    steps = [
        VectorAssembler(inputCols=columns, outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True, withStd=True),
        # balanced weights sum to n, so the penalty 1/(2 C) on the sum of losses is 1/(C n) on their mean; (n - 1) / n undoes the sample deviation's n - 1
        LogisticRegression(
            featuresCol="__scaled", labelCol="__label", weightCol="__weight", regParam=(n - 1) / (spec.C * n * n), elasticNetParam=0.0, standardization=False, maxIter=spec.max_iter, tol=1e-8
        ),
    ]
    scaler, fitted = Pipeline(stages=steps).fit(ready).stages[1:]
    parts = zip(columns, scaler.mean.toArray(), scaler.std.toArray(), fitted.coefficients.toArray(), strict=True)
    return Logistic({c: (medians[c], float(m), float(d), float(w)) for c, m, d, w in parts}, float(fitted.intercept), tuple(spec.log1p_features))


@dataclass(frozen=True)
class Tree:
    """A regression tree as arrays in preorder; a leaf has itself as both children."""

    feature: np.ndarray
    threshold: np.ndarray
    children: np.ndarray  # left (value at most the threshold), right
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            right = x[rows, self.feature[at]] > self.threshold[at]
            below = self.children[at, right.astype(np.int64)]
            if (below == at).all():
                return self.value[at]
            at = below


_SPLIT = re.compile(r"If \(feature (\d+) <= (\S+)\)")


def read_trees(text: str) -> list[Tree]:
    """The trees of a fitted model, from Spark ML's description of it (numbers in full)."""
    out, rows, held = [], [], []  # held: splits whose right branch is to come

    def close() -> None:
        if rows:
            feature, threshold, left, right, value = zip(*rows, strict=True)
            out.append(Tree(np.array(feature), np.array(threshold), np.array([left, right]).T, np.array(value)))
            rows.clear()

    for line in map(str.strip, text.splitlines()[1:]):
        if line.startswith("Tree "):
            close()
        elif found := _SPLIT.match(line):
            held.append(len(rows))
            rows.append([int(found[1]), float(found[2]), len(rows) + 1, None, 0.0])
        elif line.startswith("Else "):
            rows[held.pop()][3] = len(rows)
        elif line.startswith("Predict: "):
            rows.append([0, np.inf, len(rows), len(rows), float(line.removeprefix("Predict: "))])
        elif line:
            raise SchemaError(f"not a line of a tree: {line!r}")
    close()
    return out


class Trees:
    """A prefix of a boosting run: margins are weighted sums of the trees' predictions."""

    def __init__(self, trees: list[Tree], weights: list[float], columns: list[str], gains: list[np.ndarray]):
        self.trees, self.weights, self.columns, self.gains = trees, weights, columns, gains

    @classmethod
    def of(cls, model: GBTClassificationModel, columns: list[str]) -> Trees:
        return cls(read_trees(model.toDebugString), list(model.treeWeights), columns, [t.featureImportances.toArray() for t in model.trees])

    @property
    def kept(self) -> int:
        return len(self.trees)

    def prefix(self, n: int) -> Trees:
        return Trees(self.trees[:n], self.weights[:n], self.columns, self.gains[:n])

    def _values(self) -> F.Column:
        return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(-1.0 if c in NULLABLE else None).cast("double")) for c in self.columns])

    def _terms(self, values: pa.Array) -> Iterator[np.ndarray]:
        x = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(self.columns))
        for tree, weight in zip(self.trees, self.weights, strict=True):
            yield tree.predict(x) * weight

    def margins(self, matrix: DataFrame) -> DataFrame:
        """``matrix`` with ``margins``, the margin of every prefix of the run."""

        def work(values: pa.Array) -> pa.Array:
            sums = np.cumsum(np.stack(list(self._terms(values)), axis=1), axis=1)
            return pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, sums.shape[1]), pa.int32()), pa.array(sums.ravel()))

        return matrix.withColumn("margins", F.arrow_udf(work, "array<double>")(self._values()))

    def score(self, matrix: DataFrame, out: str = "xgboost") -> DataFrame:
        """Probability of a mule (logistic of twice the margin)."""
        margin = F.arrow_udf(lambda values: pa.array(sum(self._terms(values), np.zeros(len(values)))), "double")
        return matrix.withColumn(out, 1 / (1 + F.exp(margin(self._values()) * -2)))

    def importance(self) -> list[tuple[str, float]]:
        """Features by their share of the trees' impurity gain, largest first."""
        total = sum(self.gains)
        whole = float(total.sum()) or 1.0
        return sorted(((c, float(v) / whole) for c, v in zip(self.columns, total, strict=True)), key=lambda x: -x[1])


def prepared(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Assembled features; undefined ones are -1, which no defined value of them is."""
    return VectorAssembler(inputCols=list(columns), outputCol="__raw").transform(matrix.fillna({c: -1.0 for c in NULLABLE}))


def fit_trees(train: DataFrame, validation: DataFrame, spec: TreeSpec, seed: int = 42, rounds: int | None = None) -> Trees:
    """Gradient-boosted trees (Spark ML), cut where the validation window is ranked best.

    All prefixes of a fit are compared by average precision in one job; the kept one is the first best from which ``early_stopping_rounds`` further trees
    bring nothing better. A fit is begun with little more than those rounds and done again with twice as many while the best tree is too near its
    end: a shorter run is the beginning of a longer one, so the result is that of all ``n_estimators`` rounds.
    """
    columns, scratch = feature_columns(train), Scratch(train.sparkSession, "trees")
    weight = scale_pos_weight(train)
    balanced = F.when(F.col(LABEL) == 1, weight).otherwise(1.0)
    ready = scratch.save(train.select("account", *columns, balanced.alias("__weight"), F.col(LABEL).cast("double").alias("__label")), "train")
    # rows in an order of their own, not the files': subsampling goes by place
    parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = prepared(ready.repartition(parts, "account").sortWithinPartitions("account"), columns).select("__raw", "__weight", "__label")
    check = scratch.save(validation.select("window", "account", LABEL, *columns), "validation")
    most, now = rounds or spec.n_estimators, min(rounds or spec.n_estimators, spec.early_stopping_rounds + FIRST_ROUNDS)
    while True:
        fitter = GBTClassifier(
            featuresCol="__raw", labelCol="__label", weightCol="__weight", maxIter=now, maxDepth=spec.max_depth, stepSize=spec.learning_rate,
            subsamplingRate=spec.subsample, featureSubsetStrategy=str(spec.colsample_bytree), seed=seed,
        )
        whole = Trees.of(fitter.fit(ready), columns)
        best = _best_prefix(whole, check, spec.early_stopping_rounds)
        if best + spec.early_stopping_rounds < whole.kept or now >= most:
            return whole.prefix(best)
        now = min(most, now * 2)


#: Scores of mules, over all prefixes, that are sent to the tasks at once (8 MB); a window with more is ranked by shuffles.
THRESHOLD_CELLS = 1 << 20


def _ranked_at_mules(whole: Trees, validation: DataFrame) -> dict[int, float]:
    """Average precision of every prefix, by its number of trees.

    Only scores that a mule has add to it, so each task counts its rows between those and nothing but counts is shuffled. The mules' scores are
    collected: the caller has counted them.
    """
    scores = whole.margins(validation.filter(F.col(LABEL) == 1)).select("margins").toArrow()["margins"].combine_chunks().flatten().to_numpy().reshape(-1, whole.kept)
    cuts, hits = zip(*[np.unique(column, return_counts=True) for column in scores.T], strict=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros(len(c) + 1, np.int64) for c in cuts]
        for batch in batches:
            running = np.zeros(batch.num_rows)
            for at, term in enumerate(whole._terms(batch["values"])):
                running = running + term
                found[at] += np.bincount(np.searchsorted(cuts[at], running, side="right"), minlength=len(found[at]))
        size = sum(map(len, found))
        prefix = np.repeat(np.arange(len(found), dtype=np.int32), [len(f) for f in found])
        spot = np.concatenate([np.arange(len(f), dtype=np.int32) for f in found])
        rows = np.concatenate(found)
        for at in range(0, size, 10_000):
            yield pa.RecordBatch.from_pydict({"prefix": prefix[at:at + 10_000], "spot": spot[at:at + 10_000], "n": rows[at:at + 10_000]})

    counted = validation.select(whole._values().alias("values")).mapInArrow(count, "prefix int, spot int, n long").groupBy("prefix", "spot").agg(F.sum("n").alias("n")).toArrow()
    above = [np.zeros(len(c) + 1, np.int64) for c in cuts]
    for at, spot, n in zip(*(counted[c].to_numpy() for c in ("prefix", "spot", "n")), strict=True):
        above[at][spot] = n
    out = {}
    for at, caught in enumerate(hits):
        over = np.cumsum(above[at][:0:-1])  # spot 0 is below every mule
        out[at + 1] = float((np.cumsum(caught[::-1]) / over * caught[::-1]).sum() / caught.sum())
    return out


def _prefix_precision(whole: Trees, validation: DataFrame, *, cells: int = THRESHOLD_CELLS) -> dict[int, float]:
    """Average precision of every prefix, by its number of trees; 0 without mules."""
    mules = validation.filter(F.col(LABEL) == 1).count()
    if not mules:
        return {}
    if mules * whole.kept <= cells:
        return _ranked_at_mules(whole, validation)
    long = whole.margins(validation).select("window", "account", LABEL, F.posexplode("margins").alias("at", "score"))
    got = average_precision(long.withColumn("scorer", (F.col("at") + 1).cast("string"))).collect()  # a row per tree
    return {int(r["scorer"]): r["average_precision"] or 0.0 for r in got}


def _best_prefix(whole: Trees, validation: DataFrame, patience: int) -> int:
    """The first prefix of the best average precision, looking no further than ``patience`` trees beyond it."""
    by = _prefix_precision(whole, validation)
    best = 1
    for n in range(1, whole.kept + 1):
        if n - best > patience:
            break
        if by.get(n, 0.0) > by.get(best, 0.0):
            best = n
    return best
