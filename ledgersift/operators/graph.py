"""The payment graph of the feature window as an edge table: PageRank, degrees, triangles, components.

Iterations are driver loops (but for small windows' PageRank, which a task runs) over tables written to the shared folder (no lineage builds up, no executor holds the only copy);
only a few sums an iteration reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.config import Window
from ledgersift.operators.components import connected_components
from ledgersift.operators.population import with_windows
from ledgersift.scratch import Scratch
from ledgersift.skew import join_per_key


def edges(txns: DataFrame, windows: Sequence[Window]) -> DataFrame:
    """Distinct directed ``window, src, dst``."""
    return with_windows(txns, windows, "feature").select("window", F.col("account_from").alias("src"), F.col("account_to").alias("dst")).distinct()


def nodes(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.select("window", F.explode(F.array("src", "dst")).alias("node")).distinct()


#: A window's edges up to this number (64 MB) are iterated by one task; more are iterated by joins.
TASK_EDGES = 4_000_000


def _iterated(damping: float, max_iter: int, tol: float, n_iter: int | None):
    """Power iteration on one window's edges in numpy: the steps of `pagerank`, without a job each."""

    def work(table: pa.Table) -> pa.Table:
        ends, place = np.unique(np.concatenate([table["src"].to_numpy(), table["dst"].to_numpy()]), return_inverse=True)
        src, dst = place[: table.num_rows], place[table.num_rows :]
        n = len(ends)
        out = np.bincount(src, minlength=n)
        share, dangling, rank = 1 / np.maximum(out, 1), out == 0, np.full(n, 1 / n)
        for _ in range(n_iter or max_iter):
            got = np.bincount(dst, (rank * share)[src], minlength=n)
            value = got * damping + rank[dangling].sum() * damping / n + (1 - damping) / n
            moved, rank = np.abs(value - rank).sum(), value
            if n_iter is None and moved < tol:
                break
        return pa.table({"window": [table["window"][0].as_py()] * n, "node": ends, "pagerank": rank})

    return work


def pagerank(
    edge_rows: DataFrame, scratch: Scratch, *, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-6, n_iter: int | None = None, task_edges: int = TASK_EDGES
) -> DataFrame:
    """``window, node, pagerank`` by power iteration on the unweighted graph, dangling mass spread evenly.

    A window stops once its ranks move by less than ``tol`` in sum (the last step counts); ``n_iter`` fixes the number of steps
    instead. Windows of up to ``task_edges`` edges (counted first) are a task each; for larger ones contributions are
    pre-aggregated by target before they are shuffled, so a node with very many payers costs one row a task, and the ranks
    of nodes with very many payees are broadcast to their edges (under 4,096 nodes, whatever the graph).
    """
    written = scratch.save(edge_rows.select("window", "src", "dst"), "edges")
    counted = {r["window"]: r["count"] for r in written.groupBy("window").count().collect()}  # a row per window
    small = [w for w, n in counted.items() if n <= task_edges]
    parts = []
    if small or not counted:
        own = written.filter(F.col("window").isin(small)).groupBy("window").applyInArrow(_iterated(damping, max_iter, tol, n_iter), "window string, node long, pagerank double")
        parts.append(scratch.save(own, "ranks-in-task"))
    if len(small) < len(counted):
        large = written.filter(~F.col("window").isin(small)) if small else written
        parts.append(_pagerank_by_joins(large, sum(n for n in counted.values() if n > task_edges), scratch, damping, max_iter, tol, n_iter))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _pagerank_by_joins(edge_rows: DataFrame, total: int, scratch: Scratch, damping: float, max_iter: int, tol: float, n_iter: int | None) -> DataFrame:
    """The iteration on ``total`` written edges; ``out`` of a node is how many of them it has, null for a dangling one."""
    degree = edge_rows.groupBy("window", "src").agg(F.count("*").alias("out"))
    sizes = nodes(edge_rows).groupBy("window").agg(F.count("*").alias("n"))  # a row per window
    ranks = nodes(edge_rows).join(F.broadcast(sizes), "window").join(degree.withColumnRenamed("src", "node"), ["window", "node"], "left")
    ranks = scratch.save(ranks.select("window", "node", "n", "out", F.try_divide(F.lit(1.0), F.col("n")).alias("rank")), "ranks-0")
    open_windows = sorted(r[0] for r in ranks.select("window").distinct().collect())
    for step in range(1, (n_iter or max_iter) + 1):
        if not open_windows:
            break
        lost = {r["window"]: r["lost"] or 0.0 for r in ranks.groupBy("window").agg(F.sum(F.when(F.col("out").isNull(), F.col("rank"))).alias("lost")).collect()}
        spread = F.create_map(*[F.lit(x) for w in open_windows for x in (w, lost.get(w, 0.0))])
        paying = ranks.filter("out is not null").select("window", F.col("node").alias("src"), "out", (F.col("rank") / F.col("out")).alias("part"))
        given = join_per_key(edge_rows.filter(F.col("window").isin(open_windows)), paying, ["window", "src"], "out", total)
        got = given.groupBy("window", F.col("dst").alias("node")).agg(F.sum("part").alias("got"))
        value = F.coalesce("got", F.lit(0.0)) * damping + F.coalesce(F.try_element_at(spread, F.col("window")), F.lit(0.0)) * damping / F.col("n") + (1 - damping) / F.col("n")
        value = F.when(F.col("window").isin(open_windows), value).otherwise(F.col("rank"))
        moved = ranks.join(got, ["window", "node"], "left").select("window", "node", "n", "out", value.alias("rank"), F.abs(value - F.col("rank")).alias("moved"))
        moved = scratch.save(moved, f"ranks-{step}")
        change = {r["window"]: r["moved"] for r in moved.groupBy("window").agg(F.sum("moved").alias("moved")).collect()}
        if n_iter is None:
            open_windows = [w for w in open_windows if change.get(w, 0.0) >= tol]
        if step > 1:
            scratch.drop(f"ranks-{step - 2}")
        ranks = moved.drop("moved")
    return ranks.select("window", "node", F.col("rank").alias("pagerank"))


def undirected(edge_rows: DataFrame) -> DataFrame:
    """Simple undirected ``window, a, b`` with a < b."""
    return edge_rows.filter("src <> dst").select("window", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def degrees(edge_rows: DataFrame) -> DataFrame:
    """``window, node, degree`` in the undirected graph, 0 for a node with self-loops only."""
    ends = undirected(edge_rows).select("window", F.explode(F.array("a", "b")).alias("node"))
    return nodes(edge_rows).join(ends.groupBy("window", "node").agg(F.count("*").alias("degree")), ["window", "node"], "left").fillna(0, ["degree"])


def triangles(edge_rows: DataFrame) -> DataFrame:
    """``window, node, triangles``: each triangle is found once, from its corner of least degree.

    Edges point from lower to higher degree (ties by id), which bounds the wedges of a hub: no node has more than sqrt(2 m) outgoing edges.
    """
    degree = degrees(edge_rows)
    of = lambda c: degree.select("window", F.col("node").alias(c), F.col("degree").alias(f"d_{c}"))
    simple = undirected(edge_rows).join(of("a"), ["window", "a"]).join(of("b"), ["window", "b"])
    low = (F.col("d_a") < F.col("d_b")) | ((F.col("d_a") == F.col("d_b")) & (F.col("a") < F.col("b")))
    up = simple.select("window", F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y"))
    wedge = up.join(up.withColumnRenamed("y", "z"), ["window", "x"]).filter("y < z")
    close = undirected(edge_rows).select("window", F.col("a").alias("y"), F.col("b").alias("z"))
    found = wedge.join(close, ["window", "y", "z"])
    corner = found.select("window", F.explode(F.array("x", "y", "z")).alias("node")).groupBy("window", "node").agg(F.count("*").alias("triangles"))
    return nodes(edge_rows).join(corner, ["window", "node"], "left").fillna(0, ["triangles"])


def graph_stats(edge_rows: DataFrame) -> DataFrame:
    """Per window: nodes, directed and undirected edges, mean and largest degree, triangles, accounts in one, share in none."""
    per = degrees(edge_rows).join(triangles(edge_rows), ["window", "node"]).groupBy("window").agg(
        F.count("*").alias("nodes"), F.sum("degree").alias("ends"), F.max("degree").alias("max_degree"), F.sum("triangles").alias("corners"),
        F.count_if(F.col("triangles") > 0).alias("accounts_in_a_triangle"),
    )
    directed = edge_rows.groupBy("window").agg(F.count("*").alias("directed_edges"))
    whole = lambda c, n: F.call_function("div", F.col(c), F.lit(n)).cast("long")
    return per.join(directed, "window").select(
        "window", "nodes", "directed_edges", whole("ends", 2).alias("undirected_edges"), F.try_divide(F.col("ends").cast("double"), F.col("nodes")).alias("mean_degree"), "max_degree",
        whole("corners", 3).alias("triangles"), "accounts_in_a_triangle", (1 - F.try_divide(F.col("accounts_in_a_triangle").cast("double"), F.col("nodes"))).alias("zero_triangle_share"),
    )


def components(edge_rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` of one window's weakly connected components, named by their smallest node; every node has a row."""
    named = connected_components(edge_rows.select(F.col("src").alias("a"), F.col("dst").alias("b")), scratch)
    return edge_rows.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_table(edge_rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``component, size, edges`` (simple undirected edges)."""
    simple = undirected(edge_rows).select(F.col("a").alias("node"))
    per_edge = simple.join(labels, "node").groupBy("component").agg(F.count("*").alias("edges"))
    return labels.groupBy("component").agg(F.count("*").alias("size")).join(per_edge, "component", "left").fillna(0, ["edges"])


def component_profile(table: DataFrame) -> DataFrame:
    """One row: nodes, edges, components, the largest and its share, median size, singletons, and how many hold a cycle."""
    largest = table.agg(F.max("size").alias("largest_component"))
    cyclic = F.col("edges") >= F.col("size")
    outside = F.col("size") < F.col("largest_component")
    return table.join(F.broadcast(largest), how="cross").agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"), F.count("*").alias("components"), F.max("largest_component").alias("largest_component"),
        F.try_divide(F.max("largest_component").cast("double"), F.sum("size")).alias("largest_share"), F.percentile("size", 0.5).alias("median_component"),
        F.count_if(F.col("size") == 1).alias("singletons"), F.count_if(cyclic).alias("components_with_a_cycle"),
        (F.count_if(cyclic & outside) / F.greatest(F.count_if(outside), F.lit(1))).alias("cycle_share_outside_largest"),
    )


#: Bands of component size: name, smallest and largest size.
BANDS = (("not in the graph", 0, 0), ("1, isolated", 1, 1), ("2 to 3, an edge or a path", 2, 3), ("4 to 50, could be a motif", 4, 50), ("over 50", 51, None))


def account_component_sizes(accounts: DataFrame, labels: DataFrame, table: DataFrame) -> DataFrame:
    """``accounts`` with the size of each account's component, 0 off the graph."""
    sized = labels.join(table.select("component", "size"), "component").select(F.col("node").alias("account"), F.col("size").alias("component_size"))
    return accounts.join(sized, "account", "left").fillna(0, ["component_size"])


def band_table(sized: DataFrame, name: str) -> DataFrame:
    """``set, band, accounts, share``: a row for each band, empty ones too."""
    size = F.col("component_size")
    inside = [(size >= low) & (size <= high if high is not None else F.lit(True)) for _, low, high in BANDS]
    counts = sized.agg(F.count("*").alias("all"), *[F.count_if(c).alias(f"b{i}") for i, c in enumerate(inside)])
    rows = F.array(*[F.struct(F.lit(i).alias("band_no"), F.lit(b[0]).alias("band"), F.col(f"b{i}").alias("accounts")) for i, b in enumerate(BANDS)])
    return counts.select("all", F.inline(rows)).select(F.lit(name).alias("set"), "band_no", "band", "accounts", F.coalesce(F.try_divide(F.col("accounts").cast("double"), F.col("all")), F.lit(0.0)).alias("share"))
