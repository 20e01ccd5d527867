"""The daily work queue: who is alerted under a budget, what that costs, and how both move with the settings.

A queue is a frame of ``keys..., account, day, score, is_mule, exposure``; keys tell apart windows, scorers, policies or capacities, so
that all of them go through one plan. Days are worked in order and an account is opened once, so each day's pick depends on those before it: each
day's picks are written, and the next day reads them, so a plan holds one day whatever the number of days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgersift.config import COST_PARAMETERS, POLICY_HORIZON, Costs, SchemaError, policy_horizon, replace_cost
from ledgersift.scratch import Scratch
from ledgersift.skew import exact_quantiles, positions

CANDIDATE_COLUMNS = ("account", "day", "score", "is_mule", "exposure")


def _checked(queue: DataFrame) -> None:
    if missing := [c for c in CANDIDATE_COLUMNS if c not in queue.columns]:
        raise SchemaError(f"the queue lacks columns {missing}")


def build_candidates(candidates: DataFrame, scored: DataFrame, scorers: Sequence[str]) -> DataFrame:
    """The queue of every scorer: ``window, scorer`` and the queue's columns. All of the population must be scored, labelled and priced."""
    needed = ["is_mule", "exposure", *scorers]
    holes = scored.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in needed]).first()
    if bad := [c for c in needed if holes[c]]:
        raise SchemaError(f"undefined for part of the population: {bad}")
    if candidates.join(scored, ["window", "account"], "left_anti").limit(1).count():
        raise SchemaError("the queue holds an account that is not in the scored population")
    joined = candidates.join(scored.select("window", "account", *needed), ["window", "account"])
    wide = joined.select("window", "account", "day", "is_mule", "exposure", *[F.col(s).cast("double").alias(s) for s in scorers])
    return wide.unpivot(["window", "account", "day", "is_mule", "exposure"], list(scorers), "scorer", "score").select("window", "scorer", *CANDIDATE_COLUMNS)


def apply_policy(queue: DataFrame, policy: str, keys: Sequence[str]) -> DataFrame:
    """The queue with unworked candidates carried to the following days of their horizon, on days that have candidates of their own."""
    _checked(queue)
    horizon = policy_horizon(policy)
    if horizon <= 1:
        return queue
    later = queue.withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    later = later.withColumn("day", (F.col("day") + F.make_dt_interval(days=F.col("__o"))).cast("timestamp"))
    days = queue.select(*keys, "day").distinct()
    return later.join(days, [*keys, "day"], "left_semi").dropDuplicates([*keys, "account", "day"]).drop("__o").select(*queue.columns)


def all_policies(queue: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every policy's queue, told apart by ``policy``."""
    parts = [apply_policy(queue, p, keys).withColumn("policy", F.lit(p)) for p in sorted(POLICY_HORIZON)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _per_group(queue: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row per group of keys: first day, days, mules, accounts."""
    accounts = queue.groupBy(*keys, "account").agg(F.max("is_mule").alias("m")).groupBy(*keys).agg(F.count_if(F.col("m") == 1).alias("mules"), F.count("*").alias("accounts"))
    days = queue.groupBy(*keys, "day").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.min("day").alias("first_day"), F.count("*").alias("n_days"), F.max("n").alias("largest_day"), F.sum("n").alias("queue_rows"))
    return accounts.join(days, list(keys)) if keys else accounts.join(days, how="cross")


#: Up to this rank Spark cuts the rows of a group off in each task, before anything is shuffled.
PRUNED_IN_TASK = 1000


def best(rows: DataFrame, keys: Sequence[str], limit: Column, most: int, scratch: Scratch, table: str) -> DataFrame:
    """The rows up to the rank ``limit`` (``most`` at most) of their keys, by score, then lowest account, with the rank as ``__r``.

    Small ranks are cut off in each task; for others the rows are ranked over range partitions, so no group meets in one task.
    """
    if most <= PRUNED_IN_TASK:
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), F.asc("account"))).cast("long")
        return rows.withColumn("__r", rank).filter(F.col("__r") <= F.lit(most)).filter(F.col("__r") <= limit)
    return positions(rows, keys, F.struct(-F.col("score"), F.col("account")), "__r", scratch, table).filter(F.col("__r") <= limit)


def select_alerts(queue: DataFrame, volumes: Sequence[int], keys: Sequence[str], n_days: int) -> DataFrame:
    """``k``, keys and the queue's columns of the rows that are alerted, for each daily volume k.

    Top k of each day by score, then lowest account, among accounts not opened on an earlier day. On the d-th day only the first d k rows can be picked, since
    at most (d - 1) k accounts were opened before; the others are cut off first.
    """
    _checked(queue)
    if any(k < 0 for k in volumes):
        raise SchemaError(f"capacity must not be negative: {min(volumes)}")
    keys, scratch = list(keys), Scratch(queue.sparkSession, "alerts")
    top = max([*volumes, 1])
    starts = queue.groupBy(*keys).agg(F.min("day").alias("__first")) if keys else queue.agg(F.min("day").alias("__first"))
    dated = queue.join(F.broadcast(starts), keys) if keys else queue.join(F.broadcast(starts), how="cross")  # a row per group
    dated = dated.withColumn("__d", F.datediff("day", "__first"))
    pruned = best(dated, [*keys, "day"], (F.col("__d") + 1) * top, n_days * top, scratch, "ranked")
    pruned = scratch.save(pruned.select(*keys, *CANDIDATE_COLUMNS, "__d", "__r"), "pruned")
    ks = F.array(*[F.lit(int(k)) for k in sorted(set(volumes))])
    rows = pruned.withColumn("k", F.explode(F.filter(ks, lambda k: F.col("__r") <= (F.col("__d") + 1) * k))).drop("__r")
    picked = None
    for d in range(n_days):
        today = rows.filter(F.col("__d") == d).drop("__d")
        if picked is not None:
            today = today.join(picked.select(*keys, "k", "account"), [*keys, "k", "account"], "left_anti")
        today = best(today, [*keys, "k"], F.col("k"), top, scratch, f"day-{d}-ranked").select("k", *keys, *CANDIDATE_COLUMNS)
        today = scratch.save(today, f"day-{d}")
        picked = today if picked is None else picked.unionByName(today)
    return picked


def coverage_curve(queue: DataFrame, volumes: Sequence[int], keys: Sequence[str], n_days: int) -> DataFrame:
    """Per group and volume: alerts, caught, false positives, missed, exposure recovered, lowest alerted score, and the group's days."""
    if not len(volumes):
        raise SchemaError("at least one volume is needed")
    keys = list(keys)
    grid = _per_group(queue, keys).withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in sorted(set(volumes))])))
    caught = F.col("is_mule") == 1
    got = select_alerts(queue, volumes, keys, n_days).groupBy(*keys, "k").agg(
        F.count("*").alias("alerts"), F.count_if(caught).alias("caught"), F.sum(F.when(caught, F.col("exposure"))).alias("exposure_recovered"), F.min("score").alias("threshold")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return grid.join(got, [*keys, "k"], "left").select(
        *keys, "k", "n_days", zero("alerts").alias("alerts"), zero("caught").alias("caught"), (zero("alerts") - zero("caught")).alias("false_positives"),
        (F.col("mules") - zero("caught")).alias("missed"), F.coalesce("exposure_recovered", F.lit(0.0)).alias("exposure_recovered"), "threshold", "queue_rows", "largest_day",
    )


def price(coverage: DataFrame, miss: Column, investigate: Column, freeze: Column) -> DataFrame:
    """Both directions of being wrong, kept apart, and their balance."""
    spent = coverage.withColumns({"investigation_cost": F.col("alerts") * investigate, "freeze_cost": F.col("false_positives") * freeze})
    gains = spent.withColumns({"ev_recovered": F.col("exposure_recovered") - F.col("investigation_cost") - F.col("freeze_cost"), "ev_missed": F.col("missed") * miss})
    net = gains.withColumn("net", F.col("ev_recovered") - F.col("ev_missed"))
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))
    return net.withColumns({"net_per_day": F.try_divide("net", F.col("n_days")), "precision_at_k": part("caught", F.col("alerts")), "recall": part("caught", F.col("caught") + F.col("missed"))})


def priced(coverage: DataFrame, costs: Costs) -> DataFrame:
    return price(coverage, F.lit(float(costs.cost_missed_mule_eur)), F.lit(float(costs.cost_investigation_eur)), F.lit(float(costs.cost_false_freeze_eur)))


def evaluate(queue: DataFrame, costs: Costs, keys: Sequence[str], n_days: int) -> DataFrame:
    """The operating point at the configured capacity."""
    return priced(coverage_curve(queue, [costs.analyst_capacity_per_day], keys, n_days), costs)


def against_chance(point: DataFrame, base_rates: DataFrame, lost: DataFrame) -> DataFrame:
    """Operating points beside what random alerts would catch, and recall over all mules of the window, unreachable ones too.

    ``base_rates``: window, scorer, base_rate; ``lost``: window, unscoreable mules.
    """
    joined = point.join(base_rates.select("window", "scorer", "base_rate"), ["window", "scorer"]).join(lost, "window", "left").fillna(0, ["unscoreable_mules"])
    return joined.select(
        "window", "scorer", "alerts", "caught", (F.col("alerts") * F.col("base_rate")).alias("expected_random_catches"),
        F.coalesce(F.try_divide(F.col("caught").cast("double"), F.col("caught") + F.col("missed") + F.col("unscoreable_mules")), F.lit(0.0)).alias("recall_of_window"),
    )


def volume_optimum(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The volume with the largest net, the smallest of equals."""
    best = F.max_by("k", F.struct("net", -F.col("k")))
    return curve.groupBy(*keys).agg(best.alias("optimal_k"), F.max("net").alias("net_at_optimum"))


def sensitivity(queue: DataFrame, costs: Costs, multipliers: Sequence[float], keys: Sequence[str], n_days: int) -> DataFrame:
    """Each cost moved alone by each multiplier; the queue is ranked once for all capacities."""
    rows = []
    for name in COST_PARAMETERS:
        for m in multipliers:
            value = float(getattr(costs, name)) * m
            moved = replace_cost(costs, name, value)
            rows.append((name, float(m), value, int(moved.analyst_capacity_per_day), float(moved.cost_missed_mule_eur), float(moved.cost_investigation_eur), float(moved.cost_false_freeze_eur)))
    grid = queue.sparkSession.createDataFrame(rows, "parameter string, multiplier double, value double, k int, __miss double, __inv double, __freeze double")
    curve = coverage_curve(queue, [r[3] for r in rows], keys, n_days).join(F.broadcast(grid), "k")  # parameters x multipliers rows
    return price(curve, F.col("__miss"), F.col("__inv"), F.col("__freeze")).drop("__miss", "__inv", "__freeze")


def break_even_curve(queue: DataFrame, costs: Costs, ratios: Sequence[float], volumes: Sequence[int], keys: Sequence[str], n_days: int) -> DataFrame:
    """For each ratio of a miss to a wrong alert: the best volume, its net, the net at the budget, and whether the budget or the grid binds."""
    wrong = costs.cost_investigation_eur + costs.cost_false_freeze_eur
    if wrong <= 0:
        raise SchemaError("a wrong alert must cost something for the ratio to be defined")
    budget = costs.analyst_capacity_per_day
    curve = coverage_curve(queue, [*volumes, budget], keys, n_days).withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    curve = price(curve, F.col("ratio") * wrong, F.lit(float(costs.cost_investigation_eur)), F.lit(float(costs.cost_false_freeze_eur)))
    listed = F.col("k").isin([int(v) for v in volumes])
    out = curve.groupBy(*keys, "ratio").agg(
        F.max_by("k", F.when(listed, F.struct("net", -F.col("k")))).alias("optimal_k"), F.max(F.when(listed, F.col("net"))).alias("net_at_optimum"), F.max(F.when(F.col("k") == budget, F.col("net"))).alias("net_at_budget")
    )
    return out.withColumns({"cost_missed_mule_eur": F.col("ratio") * wrong, "budget_binds": F.col("optimal_k") > budget, "optimal_at_grid_edge": F.col("optimal_k") == int(max(volumes))})


def crossing_ratio(curve: DataFrame, capacity: int, keys: Sequence[str]) -> DataFrame:
    """The smallest ratio whose best volume exceeds the capacity; null if none does."""
    return curve.groupBy(*keys).agg(F.min(F.when(F.col("optimal_k") > capacity, F.col("ratio"))).alias("crossing_ratio"))


def overflow_comparison(queue: DataFrame, costs: Costs, n_days: int) -> DataFrame:
    """Every window's and scorer's operating point under each policy, from the raw queue, and the alerts spent on carried rows."""
    keys = ["window", "scorer", "policy"]
    under = all_policies(queue, ["window", "scorer"])
    point = evaluate(under, costs, keys, n_days)
    worked = select_alerts(under, [costs.analyst_capacity_per_day], keys, n_days)
    carried = worked.join(queue.select("window", "scorer", "account", "day"), ["window", "scorer", "account", "day"], "left_anti").groupBy(*keys).agg(F.count("*").alias("carried_alerts"))
    return point.join(carried, keys, "left").fillna(0, ["carried_alerts"])


def overflow_verdict(table: DataFrame, configured: str) -> DataFrame:
    """How the other policies move the catches of the configured one: how many better, worse, equal, and by how much at most."""
    base = table.filter(F.col("policy") == configured).select("window", "scorer", F.col("caught").alias("__base"))
    if not base.limit(1).count():
        raise SchemaError(f"no rows of the configured policy {configured!r}")
    delta = table.filter(F.col("policy") != configured).join(base, ["window", "scorer"]).select((F.col("caught") - F.col("__base")).alias("d"))
    return delta.agg(
        F.count_if(F.col("d") > 0).alias("improved"), F.count_if(F.col("d") < 0).alias("worsened"), F.count_if(F.col("d") == 0).alias("unchanged"),
        F.coalesce(F.max(F.when(F.col("d") > 0, F.col("d"))), F.lit(0)).alias("largest_gain"), F.coalesce(F.max(F.when(F.col("d") < 0, -F.col("d"))), F.lit(0)).alias("largest_loss"),
    )


def exposure_concentration(queue: DataFrame, costs: Costs, keys: Sequence[str]) -> DataFrame:
    """Per group: the mules' exposure (total, median, mean, count, shares of the largest and the five largest), break-evens, and the queue's base rate."""
    scratch = Scratch(queue.sparkSession, "exposure")
    once = scratch.save(queue.groupBy(*keys, "account").agg(F.max("is_mule").alias("is_mule"), F.max("exposure").alias("exposure")), "once")
    mule = F.col("is_mule") == 1
    middle = exact_quantiles(once.filter(mule), keys, "exposure", [0.5], scratch, "exposures").select(*keys, F.col("quantiles")[0].alias("median"))
    ranked = once.filter(mule).withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("exposure"), "account"))).filter("__r <= 5")
    top = ranked.groupBy(*keys).agg(F.max("exposure").alias("__one"), F.sum("exposure").alias("__five"))
    per = once.groupBy(*keys).agg(
        F.sum(F.when(mule, F.col("exposure"))).alias("total"), F.avg(F.when(mule, F.col("exposure"))).alias("mean"),
        F.count_if(mule).alias("count"), F.try_divide(F.count_if(mule).cast("double"), F.count("*")).alias("base_rate"),
    )
    wrong = F.lit(float(costs.cost_investigation_eur + costs.cost_false_freeze_eur))
    need = lambda recovered: F.try_divide(wrong, recovered + float(costs.cost_missed_mule_eur + costs.cost_false_freeze_eur))
    return per.join(top, list(keys), "left").join(middle, list(keys), "left").select(
        *keys, "total", "median", "mean", "count", F.try_divide("__one", "total").alias("top_1_share"), F.try_divide("__five", "total").alias("top_5_share"),
        need(F.lit(0.0)).alias("break_even_none"), need(F.col("median")).alias("break_even_median"), need(F.col("mean")).alias("break_even_mean"), "base_rate",
    ).withColumn("random_alerts_pay_at_mean", F.col("base_rate") > F.col("break_even_mean"))
