"""The pipeline's near-duplicates stage against all pairs' exact similarity."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from ledgersift.llm import nearcopies
from ledgersift.scratch import Scratch
from tests.llm import brute

RNG = random.Random(11)
VOCAB = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in "lnrst"]


def _text(n):
    return [RNG.choice(VOCAB) for _ in range(n)]


def _near(words, changes):
    out = list(words)
    for at in RNG.sample(range(len(out)), changes):
        out[at] = "other" + RNG.choice(VOCAB)
    return out


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _groups(texts):
    sets, label = [_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if k == old else k for k in label]
    return label


@pytest.fixture(scope="module")
def rows():
    texts = ["", None, "one", "One", "one two three four", "one two three four five"]
    for n in (30, 120, 120, 400, 900):
        base = _text(n)
        texts += [" ".join(w) for w in (base, base, _near(base, 1), _near(base, max(1, n // 60)), _near(base, max(2, n // 30)), _near(base, n // 4))]
    base = _text(200)
    texts += [" ".join(_near(base, 2)) for _ in range(60)] + [" ".join(_text(40)) for _ in range(60)]
    return list(enumerate(texts))


@pytest.mark.parametrize("limit", [512, 20])
def test_components_are_those_of_all_pairs(spark, rows, limit):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = {g for g in _groups([t for _, t in rows])}
    got = nearcopies.copies_and_heads(frame, Scratch(spark, "t"), limit=limit)[1].collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want)


def test_stage_drops_near_copies(spark):
    base = _text(300)
    frame = spark.createDataFrame([(3, " ".join(base), "x"), (1, " ".join(_near(base, 4)), "y"), (2, " ".join(_text(300)), "z")], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, frame, "").collect()) == [1, 2]


def test_shingles_by_row():
    texts = ["a b c d e f", "", "A b  C d e", None, "x y"]
    grams, bounds = nearcopies.shingles(pa.array(texts))
    assert bounds.tolist() == [0, 2, 3, 4, 5, 6]
    assert grams[0] == grams[3] and grams[2] == grams[4] and len(set(grams.tolist())) == 4


def test_a_shared_id_links_nothing(spark):
    frame = spark.createDataFrame([(7, " ".join(_text(40)), "x") for _ in range(12)] + [(8, " ".join(_text(40)), "y")], "doc_id long, text string, source string")
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, frame, "").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, frame.collect()))


def test_links_of_queries_alone():
    sets = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 5, 200, 205, 400, 402)]
    assert {frozenset(p) for p in nearcopies.links(sets)} == {frozenset(p) for p in ((0, 1), (2, 3), (4, 5))}
    assert nearcopies.links(sets, [0, 0, 1, 2, 3, 4], [3]) == [(3, 2)]
    assert nearcopies.links(sets, [0, 0, 1, 1, 2, 2], [0, 3, 5]) == []


def test_every_pair_of_a_large_group_meets(spark):
    nodes = spark.createDataFrame([(0, i) for i in range(150)], "bucket long, node long")
    placed = nearcopies._left_out(nodes, spark.createDataFrame([(0, 1), (1, 2)], "a long, b long"), 20, Scratch(spark, "t")).collect()
    chunks = {}
    for r in placed:
        chunks.setdefault(r.chunk, []).append((r.node, r.query))
    seen = {frozenset((a, b)) for c in chunks.values() for a, q in c if q for b, _ in c if a != b}
    missing = {frozenset((a, b)) for a in range(150) for b in range(a)} - seen
    assert missing == {frozenset((0, 1)), frozenset((0, 2)), frozenset((1, 2))} and max(map(len, chunks.values())) < 60


def test_recall_on_the_table(spark):
    """Every pair of the table at 0.8 or more, found by comparing all pairs that share a shingle, is in one component."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = [r[0] for r in brute.one_of_each([tuple(r) for r in docs.select("doc_id", "text").collect()])]
    heads = nearcopies.copies_and_heads(docs, Scratch(spark, "t"))[1].collect()
    assert sorted(r.doc_id for r in heads) == sorted(want)
