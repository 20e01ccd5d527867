"""Mixing sources to target weights: repetition rates from words per source, whole copies plus one hash-seeded draw.

Words per document are summed by source; every source gets a target (its weight's share of the mix, held at a cap
of its own size, the excess shared again by weight among the others until none is above); rate = target / size; each document
is emitted floor(rate) times, plus once more if a uniform number hashed from the seed, its id and its text is below the fraction.

Only per-source sums are shuffled (pre-aggregated), the rates come back by a join that splits hot sources, and the shares are
settled in one ordered pass over the sources (those that reach their cap first come first), so neither a huge source nor very many sources meet in one task or on the driver.

Defined cases: null text has size 0; a very long text is read once, for its size and hash; null is a source of its own and orders last; rows that
share an id, or have none, draw apart where their texts differ; repeated rows draw alike; a source of size 0 has target 0 and rate 0; an empty table gives an empty mix; extra columns are kept
by `mix` and ignored by `mixing_plan`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.scratch import Scratch
from ledgersift.skew import global_order, join_per_key, running_totals

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"


def size_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text: each, with the white space around it, becomes one character; those are counted."""
    ones = F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "w")
    return F.when(F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)), F.char_length(ones)).otherwise(0).cast("long")


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the md5 of seed and key: the same wherever and whenever it is computed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, scratch: Scratch, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source_key, is_null, rows, source_size, target`` from ``source, size`` rows."""
    spark = sizes.sparkSession
    per = sizes.groupBy(F.coalesce("source", F.lit("")).alias("source_key"), F.col("source").isNull().alias("is_null")).agg(
        F.count("*").alias("rows"), F.sum("size").alias("source_size")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = global_order(per, [F.col("is_null"), F.col("source_key")], "rank", scratch, "sources", parts)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumns({"limit": F.col("source_size").cast("double") * cap}).withColumn("reach", F.col("limit") / F.col("weight"))
    order = F.struct("reach", "is_null", "source_key")
    run = running_totals(ranked, [], order, {"fixed": "limit", "shared": "weight", "sizes": "source_size"}, scratch, "levels")
    # a source's level, words per unit of weight, if all sources before it are at their caps
    before, rest = F.col("fixed") - F.col("limit"), F.col("shared_all") - F.col("shared") + F.col("weight")
    run = scratch.save(run.withColumn("level", (F.col("sizes_all") * share - before) / rest), "settled")
    level = run.filter(F.col("weight") * F.col("level") <= F.col("limit")).agg(F.min_by("level", order)).first()[0]
    target = F.col("limit") if level is None else F.least(F.col("weight") * level, F.col("limit"))
    return run.select("source_key", "is_null", "rows", "source_size", target.alias("target"))


def identity(key: Column, text: Column) -> Column:
    """What a row's draw hashes: id and text."""
    return F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.md5(F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8")))


def _copies(rate: Column, key: Column, seed: str) -> Column:
    """floor(rate), plus one where the key's draw is below the fraction."""
    whole = F.floor(rate)
    return (whole + F.when(draw(key, seed) < rate - whole, 1).otherwise(0)).cast("long")


def mixing_plan(docs: DataFrame, scratch: Scratch, *, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = SEED, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per document with its size, its source's size, target and rate, and the copies that the mix takes."""
    body = F.col(text).cast("string")
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), size_of(body).alias("size"), identity(F.col(key).cast("long"), body).alias("identity"))
    sized = scratch.save(base, "sized")
    targets = scratch.save(source_targets(sized, scratch, weights, share, cap), "targets")
    keyed = sized.withColumns({"source_key": F.coalesce("source", F.lit("")), "is_null": F.col("source").isNull()})
    joined = join_per_key(keyed, targets, ["source_key", "is_null"], "rows", sized.count())
    rated = joined.withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    return rated.withColumn("copies", _copies(F.col("rate"), F.col("identity"), seed)).drop("source_key", "is_null", "identity")


def mix(docs: DataFrame, scratch: Scratch, *, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = SEED, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The mix itself: every document as often as `mixing_plan` takes it, with the columns of ``docs``.

    Only sources and sizes are read for the targets, and the rates come back to the documents where they are: texts are neither written nor,
    but for sources of very few documents, shuffled.
    """
    names, rate = docs.columns, F.col("__mix_rate")
    sizes = docs.select(F.col(source).cast("string").alias("source"), size_of(F.col(text).cast("string")).alias("size"))
    targets = scratch.save(source_targets(sizes, scratch, weights, share, cap), "targets")
    total = targets.agg(F.sum("rows")).first()[0] or 0
    rates = targets.select(
        F.col("source_key").alias("__mix_key"), F.col("is_null").alias("__mix_null"), F.col("rows").alias("__mix_rows"), F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("__mix_rate")
    )
    keyed = docs.withColumns({"__mix_key": F.coalesce(F.col(source).cast("string"), F.lit("")), "__mix_null": F.col(source).isNull()})
    joined = join_per_key(keyed, rates, ["__mix_key", "__mix_null"], "__mix_rows", total)
    counted = joined.withColumn("__mix_copies", _copies(rate, identity(F.col(key).cast("long"), F.col(text)), seed)).filter("__mix_copies > 0")
    return counted.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies")))).select(*[F.col(f"`{c}`") for c in names])
