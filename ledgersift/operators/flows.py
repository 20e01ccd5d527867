"""Per-account measures of the feature window: sums, counterparties, activity, speed of onward payment.

A payment becomes two legs (received, paid). Distinct counterparties and concentration come from a two-level aggregation, by pair then by account,
so no distinct count is needed and a hub's rows are summed before they meet. Timing works on one row per account and timestamp; a
window of d days at minute resolution bounds that at 1440 d rows, however busy the account.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgersift.config import Window, ratio_windows
from ledgersift.functions.scalars import share
from ledgersift.functions.sums import exact_total, merged_parts, part_names, sum_parts
from ledgersift.operators.population import with_windows

KEY = ["window", "account"]


def legs(txns: DataFrame, windows: Sequence[Window], hours: int) -> DataFrame:
    """``window, account, other, ts, side, amount, early``: early legs lie before the inflow sub-window's end."""
    cut = F.create_map(*[x for w in windows for x in (F.lit(w.name), F.lit(ratio_windows(w, hours)[1]).cast("timestamp"))])
    seen = with_windows(txns, windows, "feature").withColumn("early", F.col("ts") < cut[F.col("window")])
    return seen.select("window", "ts", "early", F.inline(F.array(
        F.struct(F.col("account_to").alias("account"), F.col("account_from").alias("other"), F.lit("in").alias("side"), F.col("base_received").alias("amount")),
        F.struct(F.col("account_from").alias("account"), F.col("account_to").alias("other"), F.lit("out").alias("side"), F.col("base_paid").alias("amount")),
    )))


def pair_totals(all_legs: DataFrame) -> DataFrame:
    """One row per window, account and counterparty, both directions side by side; sums in parts, since totals are ranked and joined by value."""
    def of(side: str, column) -> F.Column:
        return F.when(F.col("side") == side, column)

    return all_legs.groupBy("window", "account", "other").agg(
        *[f for s in ("in", "out") for f in (
            F.count(of(s, F.lit(1))).alias(f"n_{s}"), *sum_parts(of(s, F.col("amount")), f"sum_{s}"), F.max(of(s, F.col("amount"))).alias(f"max_{s}"),
        )],
        *sum_parts(F.when((F.col("side") == "in") & F.col("early"), F.col("amount")), "early_in"),
    )


def directional(pairs: DataFrame) -> DataFrame:
    """Counts, counterparties, totals, maxima and concentration of both directions; early inflow; reciprocity."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    per = pairs.groupBy(*KEY).agg(
        *[f for s in ("in", "out") for f in (
            F.sum(f"n_{s}").alias(f"{s}_degree"), F.count_if(F.col(f"n_{s}") > 0).alias(f"unique_counterparties_{s}"),
            *merged_parts(f"sum_{s}"), zero(F.max(f"max_{s}")).alias(f"max_{s}flow"), F.max(exact_total(f"sum_{s}")).alias(f"top_{s}"),
        )],
        *merged_parts("early_in"),
        F.count_if((F.col("n_in") > 0) & (F.col("n_out") > 0)).alias("mutual"),
    )
    totals = {"total_inflow": "sum_in", "total_outflow": "sum_out", "early_inflow": "early_in"}
    per = per.withColumns({t: zero(exact_total(n)) for t, n in totals.items()}).drop(*part_names(*totals.values()))
    return per.withColumns({
        "inflow_concentration": share(F.col("top_in"), F.col("total_inflow")),
        "outflow_concentration": share(F.col("top_out"), F.col("total_outflow")),
        "reciprocity": share(F.col("mutual").cast("double"), F.col("unique_counterparties_out")),
    }).drop("top_in", "top_out", "mutual")


def pass_through(directional_rows: DataFrame, floor: float) -> DataFrame:
    """Outflow over early inflow, null where that inflow is below the floor."""
    value = F.when(F.col("early_inflow") >= floor, F.try_divide("total_outflow", "early_inflow"))
    return directional_rows.withColumn("pass_through_ratio", value).drop("early_inflow")


def activity(all_legs: DataFrame) -> DataFrame:
    """Active days, and the busiest day's share of all legs."""
    days = all_legs.groupBy(*KEY, F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))
    out = days.groupBy(*KEY).agg(F.count("*").alias("active_days"), F.max("n").alias("most"), F.sum("n").alias("total"))
    return out.select(*KEY, "active_days", F.try_divide(F.col("most").cast("double"), F.col("total")).alias("burstiness"))


def _by_time(all_legs: DataFrame) -> DataFrame:
    """One row per account and timestamp: early inflows (count, amount) and outflows."""
    money = F.col("amount").cast("decimal(28,6)")
    early = (F.col("side") == "in") & F.col("early")
    none = F.lit(0).cast("decimal(38,6)")
    return all_legs.filter((F.col("side") == "out") | F.col("early")).groupBy(*KEY, "ts").agg(
        F.count_if(early).alias("n_in"), F.count_if(F.col("side") == "out").alias("n_out"),
        F.coalesce(F.sum(F.when(early, money)), none).alias("money_in"), F.coalesce(F.sum(F.when(F.col("side") == "out", money)), none).alias("money_out"),
    )


def _hours(later: F.Column, earlier: F.Column) -> F.Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3_600_000_000.0)


def hours_to_outflow(all_legs: DataFrame) -> DataFrame:
    """Median hours from an early inflow to the account's next strictly later outflow; null without any.

    An as-of join without a join: the smallest outflow time among the following rows of one ordered window.
    """
    ahead = W.partitionBy(*KEY).orderBy("ts").rowsBetween(1, W.unboundedFollowing)
    timed = _by_time(all_legs).withColumn("next_out", F.min(F.when(F.col("n_out") > 0, F.col("ts"))).over(ahead))
    matched = timed.filter("n_in > 0 and next_out is not null").withColumn("hours", _hours(F.col("next_out"), F.col("ts")))
    return matched.groupBy(*KEY).agg(F.percentile("hours", 0.5, F.col("n_in")).alias("median_hours_to_outflow"))


def fifo_pairs(all_legs: DataFrame) -> DataFrame:
    """``window, account, latency_hours, weight``: money matched first in, first out, on the axis of cumulative amounts.

    Both sides' running sums cut the axis; each piece belongs to the first inflow and the first outflow whose sum reaches its end, found by looking
    ahead in one window, so the interval join needs no join. What only one side reaches is not matched, and a piece whose outflow does not follow its
    inflow is used up but dropped. Amounts are decimals: running sums are compared for equality.
    """
    line = W.partitionBy(*KEY).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    sums = _by_time(all_legs).withColumns({"cum_in": F.sum("money_in").over(line), "cum_out": F.sum("money_out").over(line)})
    marks = sums.select(*KEY, F.inline(F.array(
        F.struct(F.when(F.col("money_in") > 0, F.col("cum_in")).alias("edge"), F.col("ts").alias("in_ts"), F.lit(None).cast("timestamp").alias("out_ts")),
        F.struct(F.when(F.col("money_out") > 0, F.col("cum_out")).alias("edge"), F.lit(None).cast("timestamp").alias("in_ts"), F.col("ts").alias("out_ts")),
    ))).filter("edge is not null")
    cuts = marks.groupBy(*KEY, "edge").agg(F.min("in_ts").alias("in_ts"), F.min("out_ts").alias("out_ts"))
    order = W.partitionBy(*KEY).orderBy("edge")
    ahead = order.rowsBetween(0, W.unboundedFollowing)
    pieces = cuts.select(
        *KEY,
        (F.col("edge") - F.coalesce(F.lag("edge").over(order), F.lit(0))).alias("weight"),
        F.first("in_ts", ignorenulls=True).over(ahead).alias("in_ts"), F.first("out_ts", ignorenulls=True).over(ahead).alias("out_ts"),
    )
    return pieces.filter("weight > 0 and out_ts > in_ts").select(*KEY, _hours(F.col("out_ts"), F.col("in_ts")).alias("latency_hours"), F.col("weight").cast("decimal(38,6)").alias("weight"))


def weighted_median(pairs: DataFrame, value: str = "latency_hours", weight: str = "weight", name: str = "fifo_latency") -> DataFrame:
    """The first value, in order, at which the running weight reaches half of the total."""
    tied = pairs.groupBy(*KEY, value).agg(F.sum(weight).alias("w"))
    order = W.partitionBy(*KEY).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    run = tied.withColumns({"run": F.sum("w").over(order), "total": F.sum("w").over(W.partitionBy(*KEY))})
    return run.filter(F.col("run") * 2 >= F.col("total")).groupBy(*KEY).agg(F.min(value).alias(name))


def fifo_latency(all_legs: DataFrame) -> DataFrame:
    return weighted_median(fifo_pairs(all_legs))
