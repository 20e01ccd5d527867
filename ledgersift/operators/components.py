"""Connected components of an edge table, by min-neighbour hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.scratch import Scratch
from ledgersift.skew import PLAIN_JOIN_ROWS, join_counted


def connected_components(edges: DataFrame, scratch: Scratch, *, plain_rows: int = PLAIN_JOIN_ROWS) -> DataFrame:
    """Map every node of ``edges (a long, b long)`` to the smallest node that it reaches.

    Returns ``node long, component long``; self-loops, repeated and reversed edges change nothing, nodes
    without an edge are the caller's to add. Each round hooks a node on its smallest smaller neighbour,
    follows the hooks to their ends by pointer doubling, and contracts the edges to those ends. A round
    leaves at most half of the nodes that still have edges, so rounds grow with the logarithm of the
    nodes; every round's tables are written to the shared folder, so no lineage builds up. Nothing but
    row counts reaches the driver. Where there are more than ``plain_rows`` edges, the joins on a node that
    most others hook on (a star, a giant component) take its rows where they are: no task gets them all.
    """
    links = scratch.save(
        edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links-0"
    )
    # a node is hooked once and a forest has no more hooks than edges, so no table below has more rows than this
    rows = links.count()
    joined = lambda left, per_key, key, table: join_counted(left, per_key, key, rows, scratch, table, plain_rows=plain_rows)
    labels, turn = None, 0
    while not links.isEmpty():
        hooks = scratch.save(links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")), f"hooks-{turn}-0")
        step = 0
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            step += 1
            jumped = joined(hooks, up, "root", f"jump-{turn}-{step}")
            jumped = jumped.select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
            jumped = scratch.save(jumped, f"hooks-{turn}-{step}")
            done = jumped.filter("moved").isEmpty()
            hooks = jumped.drop("moved")
            if done:
                break
        over = lambda side: hooks.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        contracted = joined(joined(links, over("hi"), "hi", f"hi-{turn}"), over("lo"), "lo", f"lo-{turn}")
        contracted = contracted.select(F.coalesce("hi_root", "hi").alias("x"), F.coalesce("lo_root", "lo").alias("y"))
        turn += 1
        links = scratch.save(
            contracted.filter(F.col("x") != F.col("y")).select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), f"links-{turn}"
        )
        ends = hooks.select(F.col("node").alias("component"), F.col("root").alias("final"))
        if labels is None:
            labels = hooks.select("node", F.col("root").alias("component"))
        else:
            moved = joined(labels, ends, "component", f"moved-{turn}").select("node", F.coalesce("final", "component").alias("component"))
            labels = moved.unionByName(ends.select(F.col("component").alias("node"), F.col("final").alias("component")))
        labels = scratch.save(labels, f"labels-{turn}")
    if labels is None:
        return edges.select(F.col("a").cast("long").alias("node"), F.col("b").cast("long").alias("component")).limit(0)
    roots = labels.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    return labels.unionByName(roots.join(labels.select("node"), "node", "left_anti"))
