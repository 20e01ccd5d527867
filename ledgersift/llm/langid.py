"""Language identification: averaged hashed subword embeddings, linear softmax, calibrated rejection.

A text is the bytes of its words in lower case (A-Z), its features the byte n-grams (3 and 4 long, with one blank
as word edge) hashed into 2**14 buckets. Each bucket has an embedding; their mean over the whole text goes through a linear layer and a
softmax. Embeddings and layer are trained together by minibatch gradient descent in numpy; a tenth of the training rows is held
back to calibrate: the softmax's temperature makes a score the chance of being right, and predictions are rejected below the lowest score
from which on ``ACCURACY`` of the held-back rows are right (below ``REJECT_AT_MOST`` at most).

Training is bounded: at most about ``per_language`` rows of each language, and fewer each (but one) where ``max_rows`` in all would be passed, drawn by a
hash of id and text and taken once however often they are repeated, arrive at the driver as bucket counts (never as texts). Every language that
occurs is learned. Prediction is linear in the text, runs over Arrow buffers, and reads embedding times layer as one table; with more languages than
dimensions it reads the embeddings and the layer, so what is broadcast hardly grows with the languages.

Defined cases: null text and text without a letter are ``und`` with score 0 and rejected; null languages and ids are never learned
from; a very short text has few n-grams and is judged by them (none: the class priors), a very long one is read in pieces to its end; equal texts
are predicted alike; with nothing to learn from, every text is ``und``; extra columns are kept, but one named as the result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersift.llm import bytewords as bw
from ledgersift.llm.mixing import draw
from ledgersift.llm.workers import release, tidy

BUCKETS = 1 << 14
DIMENSION = 16
ORDERS = (3, 4)
PER_LANGUAGE = 1500
#: 1,500 rows of 20 languages; more languages have fewer rows each. A row is about 5 KB on the driver.
MAX_ROWS = 30_000
#: Numbers that the held-back rows' scores may take.
MAX_SCORES = 6_000_000
EPOCHS = 8
RATE = 0.5
UNKNOWN = "und"
#: The share of accepted predictions that shall be right; but none is rejected from REJECT_AT_MOST up.
ACCURACY = 0.99
REJECT_AT_MOST = 0.5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
_STEP = 1 << 20


def _grams(data: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of lower-cased bytes, and where each starts; a blank is allowed only at an edge."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.zeros(n, dtype=np.uint32)
    good = np.ones(n, dtype=bool)
    for k in range(order):
        part = data[k : k + n]
        code = code * np.uint32(0x01000193) ^ part
        if 0 < k < order - 1:
            good &= part != 32
    at = np.flatnonzero(good)
    code = code[at] * np.uint32(0x9E3779B1) + np.uint32(order)
    return (code >> np.uint32(32 - 14)).astype(np.int64), at


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows end to end with a blank before, between and after, and where each begins."""
    rows = len(offsets) - 1
    out = np.full(len(data) + rows + 1, 32, dtype=np.uint8)
    place = np.repeat(np.arange(1, rows + 1), np.diff(offsets))
    out[np.arange(len(data)) + place] = _LOWER[data]
    return out, offsets + np.arange(rows + 1)


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and how often each occurs."""
    raw = (text or "").encode()
    total = np.zeros(BUCKETS, dtype=np.int64)
    for a in range(0, max(len(raw), 1), _STEP):  # pieces overlap by what an n-gram can reach
        piece = np.frombuffer((b" " if a == 0 else b"") + raw[max(0, a) : a + _STEP + max(ORDERS) - 1] + (b" " if a + _STEP >= len(raw) else b""), np.uint8)
        for order in ORDERS:
            bucket, at = _grams(_LOWER[piece], order)
            own = at < _STEP + (a == 0) if a + _STEP < len(raw) else np.ones(len(at), bool)
            total += np.bincount(bucket[own], minlength=BUCKETS)
    which = np.flatnonzero(total)
    return which, total[which]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket x language: embedding times layer; with a layer: bucket x dimension
    bias: np.ndarray
    temperature: float
    reject_below: float
    layer: np.ndarray | None = None

    def scores(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        mean = sums / np.maximum(n, 1)[:, None]
        logits = ((mean if self.layer is None else mean @ self.layer) + self.bias) / self.temperature
        return _softmax(logits)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Best language's number and its probability, for each text."""
        data, offsets = bw.flat(texts)
        rows, k = len(offsets) - 1, self.table.shape[1]
        sums, n = np.zeros((rows, k)), np.zeros(rows)
        a = 0
        while a < rows:  # a few rows at a time, a giant row in pieces
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _STEP, side="right")) - 1)
            if offsets[b] - offsets[a] <= 2 * _STEP:
                text, begins = _padded(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for order in ORDERS:
                    bucket, at = _grams(text, order)
                    row = np.searchsorted(begins, at, side="right") - 1
                    row = np.minimum(row, b - a - 1)
                    for j in range(k):
                        sums[a:b, j] += np.bincount(row, self.table[bucket, j], minlength=b - a)
                    n[a:b] += np.bincount(row, minlength=b - a)
            else:
                which, often = counts(data[offsets[a] : offsets[b]].tobytes().decode())
                sums[a] = often @ self.table[which]
                n[a] = often.sum()
            a = b
        best, score = np.zeros(rows, int), np.zeros(rows)
        step = max(1, MAX_SCORES // max(1, len(self.languages)))
        for a in range(0, rows if k else 0, step):
            probability = self.scores(sums[a : a + step], n[a : a + step])
            best[a : a + step], score[a : a + step] = probability.argmax(axis=1), probability.max(axis=1)
        return best, score


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> LanguageModel | None:
    """Train on (language, buckets, counts)."""
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    number = {v: i for i, v in enumerate(languages)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    k = len(languages)
    held = max(1, min(len(rows) // 10, MAX_SCORES // k)) if len(rows) >= 20 else 0
    train, check = order[held:], order[:held]
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSION))
    layer = rng.normal(0, 0.1, (DIMENSION, k))
    bias = np.zeros(k)
    target = np.array([number[r[0]] for r in rows])
    share = [(r[1], (r[2] / max(1, r[2].sum())).astype(np.float32)) for r in rows]
    square = np.full(BUCKETS, 1e-8)
    size = 32
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(train), size):
            batch = train[at : at + size]
            hidden = np.stack([v @ embed[b] for b, v in (share[i] for i in batch)])
            gap = _softmax(hidden @ layer + bias)
            gap[np.arange(len(batch)), target[batch]] -= 1
            gap /= len(batch)
            back = gap @ layer.T
            layer -= rate * hidden.T @ gap
            bias -= rate * gap.sum(axis=0) * 0.1
            for i, g in zip(batch, back, strict=True):
                b, v = share[i]
                square[b] += v * v * (g @ g)
                embed[b] -= (rate * v / np.sqrt(square[b]))[:, None] * g * 0.1
        rng.shuffle(train)
    model = LanguageModel(languages, embed @ layer, bias, 1.0, 0.0) if k <= DIMENSION else LanguageModel(languages, embed, bias, 1.0, 0.0, layer)
    if held:
        logits = np.stack([share[i][1] @ model.table[share[i][0]] for i in check])
        logits = (logits if model.layer is None else logits @ layer) + bias
        truth = target[check]
        loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(held), truth], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.002, 20, 120), key=loss))
        chance = _softmax(logits / model.temperature)
        model.reject_below = rejection(chance.max(axis=1), chance.argmax(axis=1) == truth)
    return model


def rejection(scores: np.ndarray, right: np.ndarray, accuracy: float = ACCURACY, at_most: float = REJECT_AT_MOST) -> float:
    """The lowest score from which on the share of right predictions reaches the accuracy, ``at_most`` if none below that does; 0 if no rejection is needed."""
    order = np.argsort(-scores, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    last = np.flatnonzero(np.r_[np.diff(scores[order]) != 0, True])  # equal scores are accepted or rejected together
    good = last[share[last] >= accuracy]
    if len(good) and good[-1] == len(order) - 1:
        return 0.0
    return float(min(at_most, scores[order][good[-1]])) if len(good) else at_most


def is_held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, *, text: str = "text", key: str = "doc_id", lang: str = "lang", per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS) -> LanguageModel | None:
    """Fit on rows that are not held out and have a language."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = rows.groupBy("lang").count().collect()  # a row per language
    if not known:
        return None
    each = max(1.0, min(per_language, max_rows / len(known)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], each / r["count"]) for r in known], "lang string, share double")
    row = F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))  # an id may stand for many texts
    sample = rows.join(F.broadcast(shares), "lang").filter(draw(row, "language-id") < F.col("share")).select("doc_id", "text", "lang").distinct()

    def work(batches):
        for batch in batches:
            got = [counts(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), batch.column("lang"), pa.array([b.astype(np.uint16).tobytes() for b, _ in got], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in got], pa.binary())], names=["doc_id", "lang", "buckets", "often"])

    got = sample.mapInArrow(tidy(work), "doc_id long, lang string, buckets binary, often binary").collect()
    ordered = sorted(got, key=lambda r: (r["doc_id"], r["lang"], bytes(r["buckets"]), bytes(r["often"])))
    model = fit([(r["lang"], np.frombuffer(r["buckets"], np.uint16), np.frombuffer(r["often"], np.uint32)) for r in ordered])
    del got, ordered
    release()
    return model


def predict(docs: DataFrame, model: LanguageModel | None, *, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out (lang, score, rejected)``."""

    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers, whatever the data

    def work(texts: pa.Array) -> pa.Array:
        own = sent.value
        valid = np.array([has_letter(t.as_py()) for t in texts], dtype=bool) & (own is not None)
        best, score = own.predict(texts) if own is not None else (np.zeros(len(texts), int), np.zeros(len(texts)))
        names = [own.languages[i] if ok else UNKNOWN for i, ok in zip(best, valid, strict=True)]
        score = np.where(valid, np.clip(score, 0.0, 1.0), 0.0)
        rejected = ~valid | (score < (own.reject_below if own is not None else 1.0))
        release()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["lang", "score", "rejected"])

    udf = F.arrow_udf(work, "lang string, score double, rejected boolean")
    return docs.withColumn(out, udf(F.col(text).cast("string")))
