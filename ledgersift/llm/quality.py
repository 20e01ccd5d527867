"""Quality classifier: cumulative-link regression on ordered grades, with shared hashed-text weights.

P(grade > k) = sigmoid(w . x - t_k) with t_0 < t_1 < ...: one weight vector for all grades and ordered thresholds. Features are
hashed: the distinct lower-cased words of the whole text, their beginnings, and a few binned shares of the text (repeated words, capitals, symbols,
separators, length). The expected grade is the sum of the tail probabilities; selection asks for the tail probability of the top grade.

Grades come from the labels: 0 toxic, 1 not toxic but of low quality, 2 neither. Training is bounded: at most about ``max_rows`` labelled rows drawn
by a hash of id and text, each taken once however often it is repeated, which reach the driver as distinct bucket numbers (at most 2**18 each); the fit is numpy
(adaptive gradient steps, thresholds as a first value and positive gaps). Prediction reads one bounded weight vector per worker.

Defined cases: null or empty text has only its bins as features; a very long text is read whole; labels that are null in any column, or without their document, are
not learned from; a document labelled twice takes its lowest grade; a constant or missing grade is learned as such (with no labels at all every tail probability is
the neutral 0.5); equal texts score alike; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.langid import is_held_out
from ledgersift.llm.mixing import draw
from ledgersift.llm.workers import release, tidy

BUCKETS = 1 << 18
GRADES = 3
MAX_ROWS = 20_000
EPOCHS = 25
RATE = 0.05
RIDGE = 1e-3
SELECT_AT = 0.5
#: Lengths of the word beginnings that are features too: they carry over to words that the labelled rows do not have.
BEGINNINGS = (4, 5, 6, 7)
#: A bucket is learned only if so many training rows have it.
LEAST_ROWS = 8

_STRIP = ".,;:!?\"'()[]{}<>#*%$&|=-_~`^+/\\"
_LETTERS = re.compile(r"[A-Za-zÀ-ɏ]")
_UPPER = re.compile(r"[A-ZÀ-Þ]")
_SYMBOL = re.compile(r"[#*%$&|=~^<>{}\[\]\\!]")


def _bin(share: float, n: int = 10) -> int:
    return min(n, int(share * n + 0.5))


def features(text: str | None) -> np.ndarray:
    """Distinct buckets of a text."""
    text = text or ""
    words = text.split()
    names = {w.strip(_STRIP) for w in set(text.lower().split())}
    n, chars = len(words), max(1, len(text))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, n - 1)
    letters = max(1, len(_LETTERS.findall(text)))
    lines = text.split("\n")
    names |= {
        f"\x00n{n.bit_length()}",
        f"\x00r{_bin(repeats)}",
        f"\x00u{_bin(len(_UPPER.findall(text)) / letters)}",
        f"\x00s{_bin(len(_SYMBOL.findall(text)) / chars, 50)}",
        f"\x00d{_bin(len(set(words)) / max(1, n))}",
        f"\x00l{_bin(len(set(lines)) / len(lines))}",
        f"\x00b{_bin(words.count('|') / max(1, n), 20)}",
        f"\x00t{_bin(sum(map(len, names)) / max(1, len(names)) / 40)}",
    }
    names.discard("")
    begin = {w[:k] for w in names for k in BEGINNINGS if len(w) > k}
    hashed = [zlib.crc32(w.encode()) for w in names] + [zlib.crc32(w.encode(), 1) for w in begin]
    return np.unique(np.array(hashed, dtype=np.int64) & (BUCKETS - 1))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, buckets: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k below the top."""
        return _sigmoid(self.weights[buckets].sum() - self.thresholds)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[int, np.ndarray]], grades: int = GRADES, seed: int = 11) -> OrdinalModel:
    """Maximise the cumulative-link likelihood of (grade, buckets)."""
    start, gaps = -1.0, np.zeros(grades - 2)  # gaps: logarithms
    if not rows:
        return OrdinalModel(np.zeros(BUCKETS), np.zeros(grades - 1))
    often = np.bincount(np.concatenate([b for _, b in rows]), minlength=BUCKETS) >= min(LEAST_ROWS, max(1, len(rows) // 50))
    learned = np.flatnonzero(often)  # the fit works on these alone
    place = np.cumsum(often) - 1
    y_all = np.array([g for g, _ in rows])
    own = [place[b[often[b]]].astype(np.int32) for _, b in rows]
    n = max(1, len(learned))
    weights, mean, seen = np.zeros(n), np.zeros(n), 0
    square, cut_square = np.full(n, 1e-4), np.full(grades - 1, 1e-2)
    rng, order = np.random.default_rng(seed), np.arange(len(rows))
    for epoch in range(EPOCHS):
        rng.shuffle(order)
        for at in range(0, len(order), 32):
            batch = order[at : at + 32]
            y, buckets = y_all[batch], np.concatenate([own[i] for i in batch])
            lengths = np.array([len(own[i]) for i in batch])
            ends = np.cumsum(lengths)
            total = np.r_[0.0, np.cumsum(weights[buckets])]
            z = total[ends] - total[ends - lengths]
            cuts = start + np.r_[0.0, np.cumsum(np.exp(gaps))]
            # P(y) = s(z - t_{y-1}) - s(z - t_y), with s(+inf) = 1 and s(-inf) = 0 at the ends
            bounds = np.r_[-np.inf, cuts, np.inf]
            upper, lower = _sigmoid(z - bounds[y]), _sigmoid(z - bounds[y + 1])
            upper, lower = np.where(y == 0, 1.0, upper), np.where(y == grades - 1, 0.0, lower)
            p = np.maximum(upper - lower, 1e-9)
            du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
            step = np.repeat((du - dl) / len(batch), lengths)  # of the log likelihood, for each bucket's weight
            present = np.bincount(buckets, minlength=n) > 0
            g = np.bincount(buckets, step, minlength=n) - RIDGE * weights * present
            square += g * g
            weights += RATE * g / np.sqrt(square)
            dcut = np.zeros(grades + 1)
            np.add.at(dcut, y, -du)
            np.add.at(dcut, y + 1, dl)
            dcut = dcut[1:grades] / len(batch)
            through = np.r_[dcut.sum(), [dcut[k + 1 :].sum() * np.exp(gaps[k]) for k in range(grades - 2)]]
            cut_square += through**2
            move = RATE * through / np.sqrt(cut_square)
            start += move[0]
            gaps = np.clip(gaps + move[1:], -6, 6)
        if epoch >= EPOCHS // 2:
            mean += weights
            seen += 1
    full = np.zeros(BUCKETS)
    full[learned] = mean[: len(learned)] / max(1, seen)
    return OrdinalModel(full, start + np.r_[0.0, np.cumsum(np.exp(gaps))])


def grade_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic.isNull() | quality.isNull(), None).when(toxic == 1, 0).when(quality == 0, 1).otherwise(2).cast("int")


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", max_rows: int = MAX_ROWS) -> OrdinalModel:
    """Fit on labelled documents that are not held out."""
    graded = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    graded = graded.filter(F.col("grade").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    labelled = texts.join(graded, "doc_id")
    share = max_rows / max(1, labelled.count())
    if share < 1:
        row = F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))  # an id may stand for many texts
        labelled = texts.filter(draw(row, "quality") < share).join(graded, "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t.as_py()).astype(np.uint32).tobytes() for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), batch.column("grade"), pa.array(got, pa.binary())], names=["doc_id", "grade", "buckets"])

    rows = labelled.select("doc_id", "grade", "text").distinct().mapInArrow(tidy(work), "doc_id long, grade int, buckets binary").collect()
    ordered = sorted(rows, key=lambda r: (r["doc_id"], bytes(r["buckets"])))
    model = fit([(r["grade"], np.frombuffer(r["buckets"], np.uint32)) for r in ordered])
    del rows, ordered
    release()
    return model


def grade(docs: DataFrame, model: OrdinalModel, *, text: str = "text", key: str = "doc_id", select_at: float = SELECT_AT) -> DataFrame:
    """``doc_id, expected_grade, p_not_toxic, p_top, selected`` of every row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))  # 2**18 weights, whatever the data

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = sent.value
        own = OrdinalModel(weights, thresholds)
        for batch in batches:
            tails = np.array([own.tails(features(t.as_py())) for t in batch.column("text")]).reshape(batch.num_rows, -1)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(tails.sum(axis=1), pa.float64()), pa.array(tails[:, 0], pa.float64()), pa.array(tails[:, -1], pa.float64()), pa.array(tails[:, -1] >= select_at, pa.bool_())],
                names=["doc_id", "expected_grade", "p_not_toxic", "p_top", "selected"],
            )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(work), "doc_id long, expected_grade double, p_not_toxic double, p_top double, selected boolean")
