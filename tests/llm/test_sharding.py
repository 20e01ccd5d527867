"""Every dimension prunes, at any number of bits."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgersift.llm import sharding
from ledgersift.scratch import Scratch


def _values_per_shard(frame, out):
    joined = out.join(frame.select("doc_id", "source", "lang", F.floor(F.log2(F.length("text") + 1)).alias("doubling")), "doc_id")
    rows = joined.groupBy("shard").agg(*[F.countDistinct(c).alias(c) for c in ("source", "lang", "doubling")]).collect()
    return {c: [r[c] for r in rows] for c in ("source", "lang", "doubling")}


def test_a_shard_holds_half_of_each_dimension(spark):
    rng = random.Random(1)
    rows = [(i, "w" * (1 << (i // 64 % 8)), f"s{i % 8}", f"l{i // 8 % 8}") for i in range(8192)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    found = _values_per_shard(frame, sharding.shard(frame, Scratch(spark, "t")))
    assert all(max(v) <= 4 for v in found.values())
    again = sharding.shard(frame.orderBy("doc_id"), Scratch(spark, "t"))
    assert again.exceptAll(sharding.shard(frame, Scratch(spark, "t"))).count() == 0


@pytest.mark.parametrize("bits", [1, 2, 4, 12])
def test_every_axis_counts_at_any_number_of_bits(spark, bits):
    frame = spark.createDataFrame([(i, "x" * (1 + 7 * i), "s", "l") for i in range(200)], "doc_id long, text string, source string, lang string")
    out = sharding.shard(frame, Scratch(spark, "t"), bits=bits)
    assert out.select("hilbert").distinct().count() >= min(1 << bits, 40)


def test_shards_of_the_table_prune(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = _values_per_shard(frame, sharding.shard(frame, Scratch(spark, "t")))
    whole = frame.agg(F.countDistinct("source").alias("source"), F.countDistinct("lang").alias("lang")).first()
    assert sum(found["lang"]) / 16 <= 0.7 * whole["lang"] and sum(found["source"]) / 16 <= 0.6 * whole["source"]
