"""Windows are told apart by their words, whatever the rolling hash says."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from ledgersift.llm import bytewords, substring
from ledgersift.scratch import Scratch
from tests.llm import brute


def _thue_morse(order):
    word = "a"
    for _ in range(order):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def _stripped(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substring.strip_repeats(frame, Scratch(spark, "t"), block_bytes=3000).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got)) == sorted(brute.strip_repeats(list(enumerate(texts))))
    return got


def test_texts_of_equal_rolling_hash_keep_their_words(spark):
    word = _thue_morse(10)
    other = word.translate(str.maketrans("ab", "ba"))
    data, offsets = bytewords.flat(pa.array([f"{word} {other}"]))
    assert len(set(bytewords.word_hashes(data, *bytewords.word_bounds(data, offsets)[:2]).tolist())) == 1
    common = " ".join(f"w{i}" for i in range(34))
    got = _stripped(spark, [f"{common} {word}", f"{common} {other}"])
    assert all(r.n_removed == 0 for r in got)


@pytest.mark.parametrize("bits", [0, 1])
def test_result_does_not_rest_on_the_rolling_hash(bits):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(9)]
    passage = " ".join(rng.choice(vocab) for _ in range(50))
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 120))) for _ in range(12)]
    texts += [f"{t}\t {passage.replace(' ', '  ')}\n x" for t in texts[:4]] + [passage, passage, "", None]
    whole = pa.chunked_array([pa.array(texts)])
    data, starts, ends, first, at, _ = substring._anchors(whole)
    weak = bytewords.window_hashes(bytewords.word_hashes(data, starts, ends), substring.ANCHOR, 1) & np.uint64(bits)
    weak = weak[np.flatnonzero(at)][:, None]
    at[at] = substring._answered(weak, substring._recurring(1)(substring._report(0, weak, 3)), 3)
    assert at.sum() == len(weak)
    candidate = bytewords.covered(at, substring.PERIOD - 1, 0) & bytewords.runs_inside(first, len(starts), substring.WINDOW)
    digests = bytewords.window_digests(data, starts, ends, np.flatnonzero(candidate), substring.WINDOW)
    said = substring._recurring(2)(substring._report(0, digests, 3))
    assert said.num_rows
    candidate[candidate] = substring._answered(digests, said, 3)
    got = substring._finish(list(range(len(texts))), whole, bytewords.covered(candidate, 0, substring.WINDOW - 1), (data, starts, ends, first))
    assert list(zip(*got, strict=True)) == brute.strip_repeats(list(enumerate(texts)))


def test_white_space_between_words_makes_no_difference():
    texts = pa.array(["a b  c\td\n e", "a b c d e", "ab c d e"])
    data, offsets = bytewords.flat(texts)
    starts, ends, first = bytewords.word_bounds(data, offsets)
    digests = bytewords.window_digests(data, starts, ends, np.flatnonzero(bytewords.runs_inside(first, len(starts), 4)), 4)
    assert (digests[:2] == digests[2:4]).all() and not (digests[4] == digests[:4]).all(axis=1).any()


def test_a_text_beyond_a_piece_agrees(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(5000)]
    long = " ".join(rng.choice(vocab) for _ in range(600_000))  # 3 MB: the hashes are made in pieces
    inside = " ".join(long.split()[300_000:300_060])
    _stripped(spark, [long, f"x {inside} y", "z"])
