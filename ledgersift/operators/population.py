"""Who is scored, what they turned out to be, and on which days they can be worked.

Every operator takes all windows at once: a payment is copied to the windows that hold it by a generated array (no join), and ``window``
is part of each key. Money received in the label window is labelled; money before it builds the history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.config import Window
from ledgersift.functions.sums import exact_total, part_names, sum_parts


def _between(ts: Column, start: Column, end: Column) -> Column:
    return (ts >= start) & (ts < end)


def with_windows(txns: DataFrame, windows: Sequence[Window], side: str) -> DataFrame:
    """One row per payment and window whose ``side`` (feature or label) holds it; filters reach the scan."""
    bounds = [(getattr(w, f"{side}_start"), getattr(w, f"{side}_end")) for w in windows]
    ts = F.col("ts")
    rows = F.array(*[F.struct(F.lit(w.name).alias("window"), F.lit(a).cast("timestamp").alias("a"), F.lit(b).cast("timestamp").alias("b")) for w, (a, b) in zip(windows, bounds, strict=True)])
    held = F.filter(rows, lambda w: _between(ts, w["a"], w["b"]))
    spanned = txns.filter(_between(ts, F.lit(min(a for a, _ in bounds)), F.lit(max(b for _, b in bounds))))
    return spanned.withColumn("__w", F.explode(held)).withColumn("window", F.col("__w.window")).drop("__w")


def before(txns: DataFrame, cutoff) -> DataFrame:
    """Rows strictly before the cut-off: what a feature may see."""
    return txns.filter(F.col("ts") < F.lit(cutoff))


def population(txns: DataFrame, windows: Sequence[Window]) -> DataFrame:
    """``window, account``: receivers in the feature window."""
    return with_windows(txns, windows, "feature").select("window", F.col("account_to").alias("account")).distinct()


def _received(txns: DataFrame, windows: Sequence[Window]) -> DataFrame:
    seen = with_windows(txns, windows, "label")
    got = seen.groupBy("window", F.col("account_to").alias("account")).agg(F.max("is_laundering").cast("int").alias("is_mule"), *sum_parts(F.col("base_received"), "exposure"))
    return got.withColumn("exposure", exact_total("exposure")).drop(*part_names("exposure"))


def labels(txns: DataFrame, windows: Sequence[Window]) -> DataFrame:
    """Exactly the population, each account a mule if it received a flagged payment in the label window, with its inflow there."""
    return population(txns, windows).join(_received(txns, windows), ["window", "account"], "left").select(
        "window", "account", F.coalesce("is_mule", F.lit(0)).alias("is_mule"), F.coalesce("exposure", F.lit(0.0)).alias("exposure")
    )


def unscoreable(txns: DataFrame, windows: Sequence[Window]) -> DataFrame:
    """``window, account``: flagged receivers of the label window without history."""
    flagged = _received(txns, windows).filter("is_mule = 1").select("window", "account")
    return flagged.join(population(txns, windows), ["window", "account"], "left_anti")


def window_summary(txns: DataFrame, windows: Sequence[Window]) -> DataFrame:
    """Per window: population, mules, base rate, mules without history, and the share of mules that can be reached at all."""
    got = _received(txns, windows).filter("is_mule = 1").select("window", "account", F.lit(1).alias("flagged"))
    both = population(txns, windows).withColumn("scored", F.lit(1)).join(got, ["window", "account"], "full_outer")
    totals = both.groupBy("window").agg(
        F.sum(F.coalesce("scored", F.lit(0))).alias("population"),
        F.count_if(F.col("scored").isNotNull() & F.col("flagged").isNotNull()).alias("mules"),
        F.count_if(F.col("scored").isNull()).alias("unscoreable_mules"),
    )
    inside = F.col("mules") + F.col("unscoreable_mules")
    return totals.select(
        "window", "population", "mules", F.try_divide(F.col("mules").cast("double"), F.col("population")).alias("base_rate"),
        "unscoreable_mules", inside.alias("mules_in_window"), F.try_divide(F.col("mules").cast("double"), inside).alias("reachability_ceiling"),
    )


def daily_candidates(txns: DataFrame, windows: Sequence[Window]) -> DataFrame:
    """``window, account, day``: scored accounts on the label days on which they receive."""
    days = with_windows(txns, windows, "label").select("window", F.col("account_to").alias("account"), F.date_trunc("day", "ts").alias("day")).distinct()
    return days.join(population(txns, windows), ["window", "account"], "left_semi")


def account_flows(txns: DataFrame) -> DataFrame:
    """``account, inflow, outflow`` in base currency over all rows, 0 for a side without payments."""
    legs = txns.select(F.explode(F.array(
        F.struct(F.col("account_to").alias("account"), F.col("base_received").alias("received"), F.lit(0.0).alias("paid")),
        F.struct(F.col("account_from").alias("account"), F.lit(0.0).alias("received"), F.col("base_paid").alias("paid")),
    )).alias("leg")).select("leg.*")
    return legs.groupBy("account").agg(F.coalesce(F.sum("received"), F.lit(0.0)).alias("inflow"), F.coalesce(F.sum("paid"), F.lit(0.0)).alias("outflow"))


def daily_volume(txns: DataFrame) -> DataFrame:
    """``day, payments, laundering, share`` over the whole table."""
    out = txns.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("payments"), F.sum(F.col("is_laundering").cast("long")).alias("laundering"))
    return out.withColumn("share", F.try_divide(F.col("laundering").cast("double"), F.col("payments")))
