"""Near copies for the pipeline: MinHash bands over five-word shingles, exact Jaccard similarity, components.

A text is the set of its word shingles (ASCII lower case; a text under five words is one shingle, null and empty texts are equal).
Texts of similarity 0.8 or more are linked. Candidates come from 20 bands of 5 minima: a pair at exactly 0.8 shares a band
with probability 0.9996. The shingle sets of candidates are compared whole, so a link is never a guess; what is sent are only the sets of
texts that share a band with another text, or a group that the caller names (the pipeline: the components of op 6's BK-trees). The trees alone
do not find such pairs: most lie 3 to 11 bits apart.

A band's texts meet in one task up to ``limit`` of them and are compared until all are linked or all pairs are seen. More are dealt into
chunks of that size, each with the same ``HUBS`` texts, which join most of the group. The texts that are then not in the group's largest component
are compared, in blocks, with all texts of the group that are in another component: so no task grows with the group, and no pair is left out.

Defined cases: null and empty texts are equal; a very long text is hashed in pieces; repeated rows are counted; null ids order last; empty tables give no
row; other columns are ignored.

The graph's nodes are text hashes: exact copies are one node, and an id repeated with other texts links nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.llm import bytewords as bw
from ledgersift.llm.sizes import sent
from ledgersift.llm.workers import tidy
from ledgersift.operators.components import connected_components
from ledgersift.scratch import Scratch

SHINGLE = 5
#: Similarity from which two texts are linked, as a fraction of whole numbers.
SIMILARITY = (4, 5)
BANDS, ROWS = 20, 5
LIMIT = 512
HUBS = 16
SEED = 42

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_TURNS = bw.mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1)
_STEP = 1 << 16


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' shingles end to end (one at least a row), and where each row begins (one more at the end)."""
    data, offsets = bw.flat(texts)
    data = _FOLD[data]
    starts, ends, first = bw.word_bounds(data, offsets)
    if not len(first):
        first = np.zeros(len(offsets), np.int64)
    words, n = bw.word_hashes(data, starts, ends), np.diff(first)
    bounds = np.concatenate([[0], np.cumsum(np.maximum(n - SHINGLE + 1, 1))]).astype(np.int64)
    out = np.zeros(bounds[-1], dtype=np.uint64)
    whole = np.ones(len(out), dtype=bool)
    for i in np.flatnonzero(n < SHINGLE):
        whole[bounds[i]] = False
        if n[i]:
            out[bounds[i]] = bw.window_hashes(words[first[i] : first[i + 1]], int(n[i]), SEED + int(n[i]))[0]
    out[whole] = bw.window_hashes(words, SHINGLE, SEED)[np.flatnonzero(bw.runs_inside(first, len(words), SHINGLE))]
    return out, bounds


def bands(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A key for each row and band: rows agree in it where the band's minima agree."""
    rows = len(bounds) - 1
    least = np.empty((BANDS * ROWS, rows), dtype=np.uint64)
    a = 0
    while a < rows:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + _STEP, side="right")) - 1)
        part, begins = grams[bounds[a] : bounds[b]], bounds[a:b] - bounds[a]
        for k in range(BANDS * ROWS):
            least[k, a:b] = np.minimum.reduceat((part ^ _TURNS[0, k]) * (_TURNS[1, k] | np.uint64(1)), begins)
        a = b
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], rows, axis=1)
    for k in range(ROWS):
        keys = bw.mix(keys * np.uint64(0xD1342543DE82EF95) + least[k::ROWS])
    return keys.T


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    part, whole = SIMILARITY
    if min(len(a), len(b)) * whole < max(len(a), len(b)) * part:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * whole >= (len(a) + len(b) - shared) * part


def links(sets: list[np.ndarray], labels: list[int] | None = None, queries: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges that join the sets as all similar pairs with a query do: a pair is skipped only where both are joined already.

    Equal labels are joined from the start (none are, by default); by default all sets are queries.
    """
    labels = list(range(len(sets))) if labels is None else labels
    queries = list(range(len(sets))) if queries is None else queries
    asked, groups = set(queries), {}
    for j in range(len(sets)):
        if j not in asked:
            groups.setdefault(labels[j], []).append(j)
    out = []
    for i in queries:
        apart, joined = {}, [i]
        for label, group in groups.items():
            hit = None if label == labels[i] else next((j for j in group if similar(sets[i], sets[j])), None)
            if hit is None and label != labels[i]:
                apart[label] = group
            else:
                out += [(i, hit)] if hit is not None else []
                joined = group + joined
        groups = apart | {labels[i]: joined}
    return out


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in bw.slices(whole, "text")):
        keys = bands(*shingles(batch.column("text"))).astype(np.uint64).view(np.int64) if len(batch) else np.zeros((0, BANDS), np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(np.ascontiguousarray(keys).ravel()))
        yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), lists], names=["doc_id", "text_hash", "bands"])


_MEMBER = "chunk long, component long, query boolean"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in bw.slices(whole, "text")):
        grams, bounds = shingles(batch.column("text"))
        sets = [np.unique(grams[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.record_batch([batch.column("node"), batch.column("places"), pa.array(sets, pa.binary())], names=["node", "places", "grams"])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for group in batch.column("members"):
            members = {}
            for m in group.values:
                node, query = m["node"].as_py(), m["query"].as_py()
                if node not in members or query:  # of both kinds in its own block, a query
                    members[node] = (m["component"].as_py(), query, np.frombuffer(m["grams"].as_py(), np.uint64))
            nodes = sorted(members)
            queries = [i for i, n in enumerate(nodes) if members[n][1]]
            for i, j in links([members[n][2] for n in nodes], [members[n][0] for n in nodes], queries):
                a.append(nodes[i])
                b.append(nodes[j])
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _edges(rows: DataFrame, placed: DataFrame, classes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Links among the texts that ``placed (node, chunk, component, query)`` puts in one chunk."""
    wanted = placed.groupBy("node").agg(F.collect_set(F.struct("chunk", "component", "query")).alias("places"))
    wanted = scratch.save(wanted.join(classes.select(F.col("text_hash").alias("node"), F.col("doc_id").alias("own_id")), "node"), f"wanted-{name}")
    wanted = sent(wanted, F.size("places") * 32 + 48)
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("node"))
    sets = rows.join(wanted, same).select("node", "places", "text").mapInArrow(tidy(_sets), f"node long, places array<struct<{_MEMBER.replace(' ', ':').replace(',:', ',')}>>, grams binary")
    members = sets.select("node", "grams", F.inline("places")).groupBy("chunk").agg(F.collect_list(F.struct("node", "grams", "component", "query")).alias("members"))
    return scratch.save(members.select("members").mapInArrow(tidy(_link), "a long, b long").distinct(), f"edges-{name}")


def _left_out(large: DataFrame, edges: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """Chunks for the texts of large groups that are not yet in the group's largest component, each against every block of its group."""
    half = max(1, limit // 2)
    joined = connected_components(edges, scratch)
    known = large.join(joined, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    known = scratch.save(known, "known")
    per = known.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    main = per.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    tagged = known.join(main, "bucket").withColumn("query", F.col("component") != F.col("main"))
    counts = tagged.groupBy("bucket").agg(F.count_if("query").alias("asked"), F.count("*").alias("n")).filter("asked > 0")
    blocks = counts.select("bucket", F.ceil(F.col("asked") / half).cast("int").alias("q"), F.ceil(F.col("n") / half).cast("int").alias("m"))
    dealt = tagged.join(blocks, "bucket").withColumn("own", F.xxhash64("node"))
    asked = dealt.filter("query").select("node", "component", "bucket", F.pmod("own", "q").alias("i"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"), F.lit(True).alias("query"))
    others = dealt.select("node", "component", "bucket", F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("i"), F.pmod("own", "m").alias("j"), F.lit(False).alias("query"))
    both = asked.select("node", "component", "bucket", "i", "j", "query").unionByName(others.select("node", "component", "bucket", F.col("i").cast("long").alias("i"), "j", "query"))
    return both.select("node", F.xxhash64("bucket", F.col("i").cast("long"), F.col("j").cast("long")).alias("chunk"), "component", "query")


def copies_and_heads(docs: DataFrame, scratch: Scratch, *, groups: DataFrame | None = None, text: str = "text", key: str = "doc_id", limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_hash, n`` of every different row, with how often it occurs; and of the one that stands for each component.

    It is the one with the smallest id, without any id the one with the smallest text hash, and so among texts that share the id.
    ``groups`` (``text_hash, component``) names texts that another method puts together: they are compared as those of a band are.
    """
    body = F.col(text).cast("string")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    found = scratch.save(rows.mapInArrow(tidy(_prints), "doc_id long, text_hash long, bands array<long>"), "bands")
    copies = scratch.save(found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")), "copies")
    least = copies.groupBy("text_hash").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "n")).alias("h"))
    classes = scratch.save(least.select("text_hash", "h.unnamed", "h.doc_id", "h.n"), "classes")

    met = found.select("text_hash", F.explode("bands").alias("band")).groupBy("band").agg(F.collect_set("text_hash").alias("nodes")).filter(F.size("nodes") > 1)
    if groups is not None:
        met = met.select("nodes").unionByName(groups.groupBy("component").agg(F.collect_set("text_hash").alias("nodes")).filter(F.size("nodes") > 1).select("nodes"))
    met = met.select(F.sort_array("nodes").alias("nodes")).distinct()  # near copies share several bands with the same members
    parts = F.ceil(F.size("nodes") / F.lit(limit)).cast("int")
    each = met.select(F.xxhash64("nodes").alias("bucket"), parts.alias("parts"), F.posexplode("nodes").alias("at", "node"))
    each = scratch.save(each, "met")
    of = F.when(F.col("at") < HUBS, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.col("at") % F.col("parts")))
    placed = each.select("node", F.explode(of).alias("part"), "bucket").select("node", F.xxhash64("bucket", "part").alias("chunk"), F.col("node").alias("component"), F.lit(True).alias("query"))
    edges = _edges(rows, placed, classes, scratch, "groups")
    large = each.filter("parts > 1").select("bucket", "node")
    if not large.isEmpty():
        edges = edges.unionByName(_edges(rows, _left_out(large, edges, limit, scratch), classes, scratch, "left-out"))
    joined = connected_components(edges, scratch).withColumnRenamed("node", "text_hash")
    labelled = classes.join(joined, "text_hash", "left").withColumn("component", F.coalesce("component", "text_hash"))
    heads = labelled.groupBy("component").agg(F.min(F.struct("unnamed", "doc_id", "text_hash", "n")).alias("h")).select("h.doc_id", "h.text_hash", "h.n")
    return copies, scratch.save(heads, "heads")
