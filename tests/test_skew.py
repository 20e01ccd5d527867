"""The helpers that keep hot keys and long orders out of single tasks."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgersift.operators import graph
from ledgersift.operators.components import connected_components
from ledgersift.scratch import Scratch, shared_folder
from ledgersift.skew import global_order, join_per_key, running_totals


def test_join_per_key_splits_hot_keys(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(3000)}", i) for i in range(9000)]
    left = spark.createDataFrame(rows, "k string, i long")
    per = left.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("least")).filter("n > 1")
    for total in (9000, 10**9, 1):  # some keys hot, none, all
        got = join_per_key(left, per, ["k"], "n", total)
        least = {}
        for k, i in rows:
            least.setdefault(k, []).append(i)
        want = sorted((k, i, min(least[k]) if len(least[k]) > 1 else None) for k, i in rows)
        assert sorted((tuple(r) for r in got.select("k", "i", "least").collect()), key=repr) == sorted(want, key=repr)


def test_global_order(spark):
    rows = [(i * 7919 % 500,) for i in range(500)]
    frame = spark.createDataFrame(rows, "v long").repartition(5)
    got = global_order(frame, [F.col("v")], "place", Scratch(spark, "t"), "o", 4).collect()
    assert sorted((r.v, r.place) for r in got) == [(i, i) for i in range(500)]
    assert global_order(frame.filter("false"), [F.col("v")], "place", Scratch(spark, "t"), "o", 4).count() == 0


def test_running_totals_do_not_depend_on_the_way(spark):
    rng = random.Random(2)
    rows = [(k, v, rng.randrange(5)) for k in "ab" for v in rng.sample(range(1000), 300)] + [("a", None, 3)]
    frame = spark.createDataFrame(rows, "k string, v long, n long")
    ways = [running_totals(frame, ["k"], F.col("v").asc_nulls_first(), {"upto": "n"}, Scratch(spark, "t"), "r", window_rows=w) for w in (10_000, 10)]
    one, two = (sorted((tuple(r) for r in w.select("k", "v", "n", "upto", "upto_all").collect()), key=repr) for w in ways)
    assert one == two
    for k, v, _, upto, whole in one:
        assert whole == sum(n for x, _, n in rows if x == k)
        assert upto == sum(n for x, y, n in rows if x == k and (y is None or v is not None and y <= v))


def test_shared_folder_is_the_sessions(spark):
    class Named:
        conf = {"spark.checkpoint.dir": "file:///tmp/somewhere/"}

    assert shared_folder(Named) == "file:///tmp/somewhere"
    assert shared_folder(spark)


def _smallest_reached(pairs):
    parent = {}

    def end(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        one, other = sorted((end(a), end(b)))
        parent[other] = one
    return {x: end(x) for x in parent}


def test_components_with_hot_nodes_split(spark):
    """Stars, a chain that joins two of them and scattered pairs: some nodes hot, most not, at both kinds of join."""
    rng = random.Random(3)
    star = [(7, 1000 + i) for i in range(3000)] + [(900_000, 10_000 + i) for i in range(2000)]
    chain = [(20_000 + i, 20_001 + i) for i in range(50)] + [(20_000, 1500), (20_050, 900_000)]
    pairs = [(rng.randrange(100_000, 104_000), rng.randrange(100_000, 104_000)) for _ in range(2500)]
    rows = star + chain + pairs
    found = connected_components(spark.createDataFrame(rows, "a long, b long"), Scratch(spark, "t"), plain_rows=0).collect()
    want = _smallest_reached([r for r in rows if r[0] != r[1]])
    assert {r.node: r.component for r in found} == want and len(found) == len(want)


def test_pagerank_by_joins_with_a_hub_that_pays_all(spark):
    rng = random.Random(4)
    rows = {("w", 1, 100 + i) for i in range(4000)} | {("w", rng.randrange(100, 4100), rng.randrange(100, 4100)) for _ in range(3000)}
    edges = spark.createDataFrame(sorted(rows), "window string, src long, dst long")
    one, other = ({r.node: r.pagerank for r in graph.pagerank(edges, Scratch(spark, "t"), n_iter=4, task_edges=n).collect()} for n in (10**6, 0))
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-12 for k in one)
    assert abs(sum(other.values()) - 1) < 1e-9
