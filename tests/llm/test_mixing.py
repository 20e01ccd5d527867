"""Targets of many sources in one pass, and draws of rows that share an id."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgersift import skew
from ledgersift.llm import mixing
from ledgersift.scratch import Scratch
from tests.llm import brute


@pytest.mark.parametrize("window_rows", [2_000_000, 10])
def test_targets_of_many_sources(spark, monkeypatch, window_rows):
    monkeypatch.setattr(skew.running_totals, "__kwdefaults__", {"window_rows": window_rows})
    rng = random.Random(5)
    sizes = {f"s{i:03}": rng.choice([0, 1, 7, 7, rng.randrange(1, 10**6)]) for i in range(300)} | {None: 12}
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = mixing.source_targets(frame, Scratch(spark, "t")).collect()
    want = brute.targets(sizes)
    assert len(got) == len(want)
    for r in got:
        assert abs(r.target - want[None if r.is_null else r.source_key]) <= 1e-6 * max(1, r.target)
    assert abs(sum(r.target for r in got) - 1.5 * sum(sizes.values())) < 1


def test_rows_that_share_an_id_draw_apart(spark):
    frame = spark.createDataFrame([(None, f"word{i}", "a") for i in range(4000)] + [(1, "x " * 4000, "b")], "doc_id long, text string, source string")
    plan = mixing.mixing_plan(frame, Scratch(spark, "t")).filter("source = 'a'")
    taken, target = plan.agg(F.sum(F.col("size") * F.col("copies")), F.max("target")).first()
    assert abs(taken - target) < 0.05 * target
