"""Hilbert-curve sharding: rows in curve order of their quantised metadata, cut into runs of equal count.

Each dimension (source, language, and length in steps of a sixteenth of a doubling) is quantised to ``bits`` bits by the share of rows up to
the middle of the value, so every axis fills its cells evenly and the curve cuts all of them alike; the Hilbert index of the cell orders
the rows, ids and checksums break ties, and shard s takes the rows from floor(s N / S) to floor((s + 1) N / S). So shards differ by one row at most, rows alike in all dimensions lie together, and a file's
minimum and maximum of any of the dimensions prune. All of it is DataFrame functions; the order comes from a range
partitioning, whose tie-breakers cut through groups of equal texts, and partition offsets, never from a single-task sort.

Defined cases: null text has size 1 and crc 0; a very long text is read once, for its size and checksum; null source or language sorts after all others, null ids after other ids; equal rows take
neighbouring slots; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.scratch import Scratch
from ledgersift.skew import global_order, join_per_key, running_totals

SHARDS = 16
BITS = 8
DIMENSIONS = ("source", "lang")
#: Steps of the length per doubling: at most 64 times as many values.
STEPS = 16


def hilbert_index(axes: Sequence[Column], bits: int = BITS) -> Column:
    """Position on the Hilbert curve of a cell with ``bits``-bit integer coordinates (Skilling's transposition)."""
    n = len(axes)
    start = F.array(*[a.cast("long") for a in axes])
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def exchange(x: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        low = q - 1
        own, first = F.get(x, i), F.get(x, F.lit(0))
        flip = own.bitwiseAND(q) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        new_first = F.when(flip, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))
        return F.transform(x, lambda v, k: F.when(k == 0, new_first).when((k == i) & ~flip, v.bitwiseXOR(swap)).otherwise(v))

    turned = F.aggregate(steps, start, exchange) if bits > 1 else start
    def against_last(x: Column, i: Column) -> Column:
        return F.transform(x, lambda v, k: F.when(k == i, v.bitwiseXOR(F.get(x, i - 1))).otherwise(v))

    gray = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), turned, against_last) if n > 1 else turned
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def finish(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))

        def fold(t: Column, b: Column) -> Column:
            set_there = F.call_function("shiftright", last, b).bitwiseAND(F.lit(1)) != 0
            return F.when(set_there, t.bitwiseXOR(F.call_function("shiftleft", one, b) - 1)).otherwise(t)

        mask = F.aggregate(F.sequence(F.lit(1), F.lit(bits - 1)), none, fold) if bits > 1 else none
        return F.transform(F.array(mask), lambda m: F.transform(x, lambda v: v.bitwiseXOR(m)))[0]

    def join_bits(x: Column) -> Column:
        pairs = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
        return F.aggregate(pairs, F.lit(0).cast("long"), lambda t, p: t * 2 + F.call_function("shiftright", F.get(x, p["i"]), p["b"]).bitwiseAND(F.lit(1)))

    bound = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731  evaluates value once
    return bound(gray, lambda g: bound(finish(g), join_bits))


def _div(a: Column, b: Column) -> Column:
    """Whole-number division of longs."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def shard(docs: DataFrame, scratch: Scratch, *, shards: int = SHARDS, bits: int = BITS, text: str = "text", key: str = "doc_id", dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Return ``doc_id, size, text_crc32, shard, slot, hilbert`` for every row of ``docs``."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        *[F.col(f"`{c}`").cast("string").alias(f"dim_{i}") for i, c in enumerate(dimensions)],
    )
    rows = scratch.save(rows, "rows")
    total = rows.count()
    cells = 1 << bits

    def by_share(values: DataFrame, order: Column, name: str, table: str) -> DataFrame:
        """The cell of each value, by the rows up to its middle."""
        run = running_totals(values, [], order, {"upto": "rows_of"}, scratch, table)
        middle = _div((F.col("upto") * 2 - F.col("rows_of")) * cells, F.col("upto_all") * 2)
        return run.withColumn(name, F.least(middle, F.lit(cells - 1)).cast("long")).drop("upto", "upto_all")

    step = F.floor(F.log2(F.col("size").cast("double")) * STEPS).cast("int")
    lengths = by_share(rows.groupBy(step.alias("step")).agg(F.count("*").alias("rows_of")), F.col("step"), "axis_length", "lengths").drop("rows_of")
    rows = rows.withColumn("step", step).join(F.broadcast(lengths), "step").drop("step")  # 64 STEPS rows at most
    for i in range(len(dimensions)):
        names = [f"k_{i}", f"null_{i}"]
        keyed = rows.withColumns({names[0]: F.coalesce(f"dim_{i}", F.lit("")), names[1]: F.col(f"dim_{i}").isNull()})
        values = by_share(keyed.groupBy(*names).agg(F.count("*").alias("rows_of")), F.struct(names[1], names[0]), f"axis_{i}", f"dimension-{i}")
        rows = join_per_key(keyed, values, names, "rows_of", total).drop(*names, f"dim_{i}")
    axes = [F.col(f"axis_{i}") for i in range(len(dimensions))] + [F.col("axis_length")]
    laid = rows.select("doc_id", "size", "text_crc32", hilbert_index(axes, bits).alias("hilbert"))
    order = [F.col("hilbert"), F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size")]
    placed = global_order(laid, order, "place", scratch, "curve", parts)
    if not total:
        return placed.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.col("place").alias("slot"), "hilbert")
    # the largest s with floor(s * total / shards) <= place
    number = _div((F.col("place") + 1) * shards - 1, F.lit(total))
    return placed.select(
        "doc_id", "size", "text_crc32", number.cast("int").alias("shard"), (F.col("place") - _div(number * total, F.lit(shards))).cast("long").alias("slot"), "hilbert"
    )
