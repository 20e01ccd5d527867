"""SimHash near-duplicates: fingerprints, BK-trees per shard, components.

Fingerprints link at Hamming distance ``radius`` (2) or less. A broadcast from the driver would need every fingerprint there, so the
trees are made and sent shard by shard: 64 bits in three pieces leave at least one piece equal under two flipped bits (in general radius + 1
pieces), so each distinct fingerprint goes to three shards, named by the first bits of a piece, and every link lies inside a shard. As many bits are
used as make shards of about ``SHARD_CODES`` fingerprints. A shard over ``shard_limit`` is split again by three whole pieces of the bits
that its fingerprints do not share yet, for the same reason, until it fits or ``MIN_FREE`` bits or fewer are free: no shard can then exceed
2**MIN_FREE fingerprints, whatever the data.

Each shard becomes a BK-tree: children are keyed by their Hamming distance to the parent. The tree is sent to every task that
searches it, each with up to ``CHUNK`` of the shard's fingerprints as queries, which follow only the edges within the radius. A search
reports one edge per linked fingerprint, to the smallest of its local component, never all pairs.

Defined cases: a null or empty text has fingerprint zero and links like any other; a very long text is hashed in pieces; equal texts and
repeated rows fall in one class; an id repeated with other texts links nothing, since the graph's nodes are fingerprints; rows whose doc_id is null
link others, but are a component_id only where the component has no other id (then it is null); other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.workers import tidy
from ledgersift.operators.components import connected_components
from ledgersift.scratch import Scratch
from ledgersift.skew import join_per_key

SHINGLE = 3
RADIUS = 2
SEED = 42
SHARD_CODES = 1024
SHARD_LIMIT = 4096
CHUNK = 1024
#: Subtrees of up to this many codes are compared at once.
LEAF = 8
#: Shards with so few free bits are not split again: they hold at most 2**13 fingerprints.
MIN_FREE = 13

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else iter([b" ".join(words)])
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, dtype=np.int64)
    hashes = map(xxhash.xxh64_intdigest, grams, repeat(SEED))
    for at in range(0, n, 1 << 16):
        h = np.fromiter(hashes, dtype=np.uint64, count=min(1 << 16, n - at))
        table = np.bincount((h.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)).ravel(), minlength=2048)
        counts += (table.reshape(8, 256) @ _BITS).ravel()
    return int(((counts * 2 > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id long, text_hash long, fp long`` (the fingerprint as a signed long) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(got.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    body = F.col(text).cast("string")
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text")).mapInArrow(tidy(work), "doc_id long, text_hash long, fp long")


class BKTree:
    """A BK-tree over distinct 64-bit codes, as arrays in preorder; ``search`` answers many queries in one walk."""

    def __init__(self, codes: np.ndarray, edge: np.ndarray, size: np.ndarray):
        self.codes, self.edge, self.size = codes, edge, size  # size: codes in the subtree

    @classmethod
    def plant(cls, codes: np.ndarray) -> tuple[BKTree, np.ndarray]:
        """The tree, and for each of its places the number of the code there."""
        n = len(codes)
        order, edge, size = np.empty(n, np.int64), np.zeros(n, np.uint8), np.ones(n, np.int32)
        at, todo = 0, [(np.arange(n), 0)] if n else []
        while todo:
            index, distance = todo.pop()
            edge[at], size[at] = distance, len(index)
            if len(index) <= LEAF:
                order[at : at + len(index)] = index
                at += len(index)
                continue
            order[at], rest = index[0], index[1:]
            at += 1
            apart = np.bitwise_count(codes[rest] ^ codes[index[0]])
            by = np.argsort(apart, kind="stable")
            cuts = np.flatnonzero(np.diff(apart[by])) + 1
            todo += [(rest[g], int(apart[g[0]])) for g in reversed(np.split(by, cuts))]
        return cls(codes[order], edge, size), order

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """Yield (place, numbers of the queries within the radius of it) of the places that have any."""
        todo = [(0, np.arange(len(queries)))] if len(self.codes) else []
        while todo:
            place, who = todo.pop()
            end = place + int(self.size[place])
            if end - place <= LEAF:
                near = np.bitwise_count(queries[who][None, :] ^ self.codes[place:end][:, None]) <= radius
                for k in np.flatnonzero(near.any(axis=1)).tolist():
                    yield place + k, who[near[k]]
                continue
            distance = np.bitwise_count(queries[who] ^ self.codes[place]).astype(np.int64)
            if (distance <= radius).any():
                yield place, who[distance <= radius]
            child = place + 1
            while child < end:
                follow = who[np.abs(distance - int(self.edge[child])) <= radius]
                if len(follow):
                    todo.append((child, follow))
                child += int(self.size[child])


def local_links(tree: BKTree, first: int, last: int, radius: int = RADIUS) -> np.ndarray:
    """Labels of the components that the tree's codes at places ``first`` to ``last`` make with all of its codes: the smallest place of each."""
    label = np.arange(len(tree.codes))
    for place, near in tree.search(tree.codes[first:last], radius):
        found = np.unique(np.r_[label[place], label[near + first]])
        if len(found) > 1:
            known = np.zeros(len(label), dtype=bool)
            known[found] = True
            label[known[label]] = found[0]
    return label


def _pieces(left: int, n: int) -> list[tuple[int, int]]:
    """(offset, width) of the n pieces of ``left`` free bits."""
    widths = [left // n + (i < left % n) for i in range(n)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _split(rows: DataFrame, free: int, n: int, used: int = 64) -> DataFrame:
    """n rows for each row of (shard, rest, ...): the first ``used`` bits of a piece join the shard's name and leave the free bits."""
    cut = []
    for k, (offset, width) in enumerate(_pieces(free, n)):
        width = min(width, used)
        piece = F.shiftrightunsigned("rest", offset).bitwiseAND(F.lit((1 << width) - 1))
        low = F.col("rest").bitwiseAND(F.lit((1 << offset) - 1))
        high = F.shiftleft(F.shiftrightunsigned("rest", offset + width), offset) if offset + width < 64 else F.lit(0).cast("long")
        name = F.concat_ws(".", F.col("shard"), F.lit(str(k)), F.hex(piece))
        cut.append(F.struct(name.alias("shard"), low.bitwiseOR(high).alias("rest"), F.lit(free - width).alias("free")))
    return rows.withColumn("cut", F.explode(F.array(*cut))).select("cut.*", "fp")


_TREE = "codes binary, edge binary, size binary, first long, last long"


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shard's tree, once for each chunk of its queries."""
    for batch in batches:
        for group in batch.column("members"):
            codes = np.sort(np.asarray(group.values.to_numpy(zero_copy_only=False), dtype=np.int64)).view(np.uint64)
            tree, _ = BKTree.plant(codes)
            body = [tree.codes.tobytes(), tree.edge.tobytes(), tree.size.tobytes()]
            begins = list(range(0, len(codes), CHUNK))
            stops = [min(a + CHUNK, len(codes)) for a in begins]
            yield pa.record_batch([*(pa.array([b] * len(begins), pa.binary()) for b in body), pa.array(begins, pa.int64()), pa.array(stops, pa.int64())], names=["codes", "edge", "size", "first", "last"])


def _searched(radius: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for codes, edge, size, first, last in zip(*(batch.column(c).to_pylist() for c in ("codes", "edge", "size", "first", "last")), strict=True):
                tree = BKTree(np.frombuffer(codes, np.uint64), np.frombuffer(edge, np.uint8), np.frombuffer(size, np.int32))
                label = local_links(tree, first, last, radius)
                tied = np.flatnonzero(label != np.arange(len(label)))
                nodes = tree.codes.view(np.int64)
                a.append(nodes[tied])
                b.append(nodes[label[tied]])
            yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return search


def shard_edges(codes: DataFrame, scratch: Scratch, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT, shard_codes: int = SHARD_CODES) -> DataFrame:
    """Edges (a, b) between the distinct codes ``fp``: in each shard from each code to the first of its local component."""
    pieces = radius + 1  # so many differing bits leave one piece equal
    used = max(0, math.ceil(math.log2(max(1, codes.count()) / shard_codes)))
    whole = codes.select(F.lit("").alias("shard"), F.col("fp").alias("rest"), F.lit(64).alias("free"), "fp")
    rows = _split(whole, 64, pieces, used) if used else whole
    edges, level, free = [], 0, {64 - w for w in (min(w, used) for _, w in _pieces(64, pieces))}
    while True:
        level += 1
        counted = rows.filter(F.col("free") > MIN_FREE).groupBy("shard").agg(F.count("*").alias("n"))
        large = scratch.save(counted.filter(F.col("n") > shard_limit).select("shard"), f"large-{level}")
        split = not large.isEmpty()
        fit = rows.join(large, "shard", "left_anti") if split else rows
        shards = fit.groupBy("shard").agg(F.collect_list("fp").alias("members")).filter(F.size("members") > 1)
        trees = shards.select("members").mapInArrow(tidy(_plant), _TREE).repartition(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        edges.append(scratch.save(trees.mapInArrow(tidy(_searched(radius)), "a long, b long").distinct(), f"edges-{level}"))
        if not split:
            break
        over = rows.join(large, "shard", "left_semi")
        parts = [_split(over.filter(F.col("free") == f), f, pieces) for f in sorted(free) if f > MIN_FREE]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        rows = scratch.save(rows, f"rows-{level}")
        free = {f - w for f in free if f > MIN_FREE for _, w in _pieces(f, pieces)}
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def near_duplicates(docs: DataFrame, scratch: Scratch, *, text: str = "text", key: str = "doc_id", radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Return ``doc_id, text_hash, fp, component, component_id`` for every row of ``docs``; ``component``, its first fingerprint, also names those without any id."""
    found = scratch.save(fingerprints(docs, text=text, key=key), "fingerprints")
    total = found.count()
    classes = scratch.save(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "classes")
    joined = connected_components(shard_edges(classes.select("fp"), scratch, radius, shard_limit), scratch)
    named = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = scratch.save(named, "named")
    least = scratch.save(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("classes")), "least")
    labelled = join_per_key(named.drop("least"), least, ["component"], "classes", named.count())
    return join_per_key(found, scratch.save(labelled, "labelled"), ["fp"], "copies", total).select("doc_id", "text_hash", "fp", "component", "component_id")
