"""Joins and ranks that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.scratch import Scratch

#: At most this many keys can each have more than 1/HOT_KEYS of all rows, whatever the data: the bound of what is broadcast.
HOT_KEYS = 4096


def join_per_key(left: DataFrame, per_key: DataFrame, keys: Sequence[str], weight: str, total: int) -> DataFrame:
    """Left join of ``left`` with one row per key, with no task for a hot key.

    ``per_key`` is unique on ``keys`` and ``weight`` is the number of rows that ``left`` has of the key.
    Keys with more than total/HOT_KEYS rows number under HOT_KEYS, so they are broadcast; every other key
    has at most that share of the rows, and goes through a plain shuffled join. Keys must not be null.
    ``weight`` is dropped from the result.
    """
    heavy = per_key.filter(F.col(weight) > F.lit(total // HOT_KEYS)).drop(weight)
    light = per_key.filter(F.col(weight) <= F.lit(total // HOT_KEYS)).drop(weight)
    hot = heavy.select(*keys)
    return left.join(F.broadcast(heavy), list(keys), "inner").unionByName(
        left.join(F.broadcast(hot), list(keys), "left_anti").join(light, list(keys), "left")
    )


#: Rows up to which Spark's own handling of skewed joins is trusted: a task that gets them all still ends soon.
PLAIN_JOIN_ROWS = 2_000_000


def join_counted(left: DataFrame, per_key: DataFrame, key: str, rows: int, scratch: Scratch, table: str, *, plain_rows: int = PLAIN_JOIN_ROWS) -> DataFrame:
    """Left join of a written table of at most ``rows`` rows with one row per key, however many rows a key has.

    Beyond ``plain_rows`` the rows of each key are counted (map-side) and go through `join_per_key`; the result is written. Keys must not be null.
    """
    if rows <= plain_rows:
        return left.join(per_key, key, "left")
    counts = left.groupBy(key).agg(F.count("*").alias("__rows"))
    known = scratch.save(counts.join(per_key, key, "left"), f"{table}-keys")  # a hot key without a partner is in it too
    return scratch.save(join_per_key(left, known, [key], "__rows", rows), f"{table}-joined")


def global_order(df: DataFrame, order: Sequence[Column], name: str, scratch: Scratch, table: str, partitions: int) -> DataFrame:
    """``df`` with its 0-based position in ``order`` as column ``name``, computed without a single-task sort.

    Rows are range-partitioned and sorted, written once (so that the ranges stay fixed however often they
    are read), and numbered inside their partition; partition offsets come from one count per partition.
    """
    spot, part = f"__{name}_spot", f"__{name}_part"
    ranged = df.repartitionByRange(max(1, partitions), *order).sortWithinPartitions(*order)
    laid = scratch.save(ranged.withColumn(spot, F.monotonically_increasing_id()), table)
    laid = laid.withColumn(part, F.shiftright(F.col(spot), 33)).withColumn(spot, F.col(spot).bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = sorted((r[part], r["count"]) for r in laid.groupBy(part).count().collect())  # one row per partition
    offsets, seen = [], 0
    for number, count in sizes:
        offsets.append((number, seen))
        seen += count
    if not offsets:
        return laid.withColumn(name, F.lit(0).cast("long")).drop(spot, part)
    starts = df.sparkSession.createDataFrame(offsets, f"{part} long, __{name}_start long")
    return laid.join(F.broadcast(starts), part).withColumn(name, F.col(f"__{name}_start") + F.col(spot)).drop(spot, part, f"__{name}_start")


#: Rows of one table of distinct values that a single ordered window may take.
WINDOW_ROWS = 2_000_000


def running_totals(values: DataFrame, keys: Sequence[str], order: Column, totals: dict[str, str], scratch: Scratch, table: str, *, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``values`` (a row per key and distinct value) with, for each ``new: column``, the sum up to and including the row, and ``new_all``, the key's sum.

    Up to ``window_rows`` rows an ordered window per key does it. Beyond, rows are range-partitioned by key and value and written, each
    partition is summed up by itself, and the sums of the partitions before it (one row per partition and key) are added: no key's
    values meet in one task.
    """
    whole = Window.partitionBy(*keys)
    laid = scratch.save(values, table)
    if laid.count() <= window_rows:
        run = whole.orderBy(order)
        return laid.withColumns({n: F.sum(c).over(run) for n, c in totals.items()} | {f"{n}_all": F.sum(c).over(whole) for n, c in totals.items()})
    part = "__part"
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = scratch.save(laid.repartitionByRange(parts, *[F.col(k) for k in keys], order).withColumn(part, F.spark_partition_id()), f"{table}-ranged")
    sums = laid.groupBy(*keys, part).agg(*[F.sum(c).alias(f"{n}_all") for n, c in totals.items()])
    before = whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = scratch.save(sums.select(*keys, part, *[F.coalesce(F.sum(f"{n}_all").over(before), F.lit(0)).alias(f"{n}_before") for n in totals], *[F.sum(f"{n}_all").over(whole).alias(f"{n}_all") for n in totals]), f"{table}-sums")
    inner = Window.partitionBy(*keys, part).orderBy(order)
    joined = laid.withColumns({n: F.sum(c).over(inner) for n, c in totals.items()}).join(sums, [*keys, part])
    return joined.withColumns({n: F.col(n) + F.col(f"{n}_before") for n in totals}).drop(part, *[f"{n}_before" for n in totals])


def positions(df: DataFrame, keys: Sequence[str], order: Column, name: str, scratch: Scratch, table: str, *, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``df`` with the 1-based position of each row among those of its keys. ``order`` must tell the rows of a key apart."""
    one = "__one"
    return running_totals(df.withColumn(one, F.lit(1).cast("long")), keys, order, {name: one}, scratch, table, window_rows=window_rows).drop(one, f"{name}_all")


def exact_quantiles(values: DataFrame, keys: Sequence[str], column: str, shares: Sequence[float], scratch: Scratch, table: str, *, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``keys, quantiles``: the column's exact quantiles, interpolated linearly between the two nearest ranks; nulls are left out.

    Works on running counts of the distinct values, so no key's values meet in one buffer. Keys without a value have no row.
    """
    known = values.filter(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("__v"))
    counts = known.groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    run = running_totals(counts, keys, F.col("__v"), {"__upto": "__n"}, scratch, table, window_rows=window_rows)
    spots = [(F.col("__upto_all") - 1) * F.lit(float(p)) for p in shares]
    at = lambda rank: F.max(F.when((F.col("__upto") - F.col("__n") <= rank) & (rank < F.col("__upto")), F.col("__v")))
    found = []
    for i, spot in enumerate(spots):
        found += [at(F.floor(spot)).alias(f"__low{i}"), at(F.ceil(spot)).alias(f"__high{i}"), F.max(spot - F.floor(spot)).alias(f"__part{i}")]
    between = [F.col(f"__low{i}") + (F.col(f"__high{i}") - F.col(f"__low{i}")) * F.col(f"__part{i}") for i in range(len(spots))]
    return run.groupBy(*keys).agg(*found).select(*keys, F.array(*between).alias("quantiles"))
