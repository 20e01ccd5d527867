"""Trees are built, prune, and find what brute force finds; ids link nothing."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ledgersift.llm import simhash
from ledgersift.scratch import Scratch
from tests.llm import brute


def _codes(n, seed=1):
    return np.unique(np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64))


def test_children_are_keyed_by_distance_and_edges_prune():
    codes = _codes(1000)
    tree, _ = simhash.BKTree.plant(codes)
    inner = [k for k in range(len(codes)) if tree.size[k] > simhash.LEAF]
    assert len(inner) > 20 and max(tree.size[1:]) < 300
    for k in inner:
        child = k + 1
        while child < k + tree.size[k]:
            whole = tree.codes[child : child + tree.size[child]]
            assert set(np.bitwise_count(whole ^ tree.codes[k]).tolist()) == {int(tree.edge[child])}
            child += int(tree.size[child])
    compared = 0
    real = np.bitwise_count

    def counting(x):
        nonlocal compared
        compared += x.size
        return real(x)

    np.bitwise_count = counting
    try:
        hits = sum(len(near) for _, near in tree.search(codes, 2))
    finally:
        np.bitwise_count = real
    assert hits == len(codes) and compared < 0.7 * len(codes) ** 2


def test_shards_of_the_table_make_trees(spark, monkeypatch):
    base = "/root/testdata/sf0.1"
    classes = simhash.fingerprints(spark.read.parquet(f"{base}/documents.parquet")).select("fp").distinct()
    sizes = []
    real = simhash.shard_edges
    codes = np.array([r.fp for r in classes.collect()], dtype=np.int64).view(np.uint64)
    used = int(np.ceil(np.log2(len(codes) / simhash.SHARD_CODES)))
    for offset, _ in simhash._pieces(64, 3):
        shard = (codes >> np.uint64(offset)) & np.uint64((1 << used) - 1)
        sizes += np.bincount(shard.astype(int)).tolist()
    assert min(sizes) > 200 and max(sizes) <= simhash.SHARD_LIMIT
    edges = {frozenset((r.a, r.b)) for r in real(classes, Scratch(spark, "t")).collect()}
    want = set()
    for i, c in enumerate(codes):
        near = np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ c) <= 2) + i + 1
        want |= {frozenset((int(c.astype(np.int64)), int(codes[j].astype(np.int64)))) for j in near}
    group = lambda pairs: _groups(pairs)
    assert group(edges) == group(want)


def _groups(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for pair in pairs:
        a, b = sorted(pair) if len(pair) == 2 else (min(pair), min(pair))
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    out = {}
    for x in parent:
        out.setdefault(find(x), set()).add(x)
    return {frozenset(v) for v in out.values() if len(v) > 1}


@pytest.mark.parametrize("limit", [64, 4096])
def test_a_dense_ball_of_codes_splits_to_the_bound(spark, monkeypatch, limit):
    """Codes of one centre that differ in 15 places: every shard of the first levels is over the limit."""
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    places = rng.sample(range(64), 15)
    codes = {centre ^ sum(1 << p for p in places if rng.random() < 0.5) for _ in range(600)}
    signed = [int(np.uint64(c).astype(np.int64)) for c in codes]
    frame = spark.createDataFrame([(c,) for c in signed], "fp long")
    got = {frozenset((r.a, r.b)) for r in simhash.shard_edges(frame, Scratch(spark, "t"), shard_limit=limit, shard_codes=100).collect()}
    want = {frozenset((a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert _groups(got) == _groups(want)


def test_a_shared_id_links_nothing(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(999)}" for _ in range(40)) for _ in range(5)]
    rows = [(7, t) for t in texts[:3]] + [(9, texts[3]), (None, texts[4]), (None, texts[3])]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()
    assert len({r.component for r in got}) == 5
    assert sorted((r.doc_id is None, r.component_id or 0) for r in got) == [(False, 7)] * 3 + [(False, 9), (True, 0), (True, 9)]


def test_a_text_beyond_a_piece_agrees():
    rng = random.Random(4)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(70_000))
    assert simhash.fingerprint(text) == brute.simhash(text)
