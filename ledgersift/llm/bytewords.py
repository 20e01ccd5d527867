"""Words and rolling hashes of whole Arrow text columns in numpy, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_WORD = (1 << 64) - 1
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
#: A random-looking 64-bit value for each byte value, from a rule (splitmix64).
_STEP = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64-bit values in which each bit depends on all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BYTE_BASE))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1024), base & _WORD, dtype=np.uint64)
        out[0] = 1
        have = _powers[base] = np.cumprod(out, dtype=np.uint64)
    return have[:n]


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column end to end, and the offsets of its rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, size: int = _STEP) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``size`` bytes of text each, so that the arrays over their words stay small."""
    _, offsets = flat(batch.column(column))
    a, rows = 0, batch.num_rows
    while a < rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and for each row the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    head[edges] = inside[edges]
    tail[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, in pieces of about 2 MB so that a giant row needs no giant array."""
    out = np.empty(len(starts), dtype=np.uint64)
    inverse = pow(_BYTE_BASE, -1, 1 << 64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _STEP, side="right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data[lo:hi]] * powers(_BYTE_BASE, hi - lo), out=sums[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((sums[e] - sums[s]) * powers(inverse, hi - lo + 1)[s] ^ (e - s).astype(np.uint64))
        a = b
    return out


def window_hashes(words: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A hash of each run of ``length`` consecutive word hashes; entry i is the run that starts at word i."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(words ^ np.uint64(seed)) * powers(_WORD_BASE, n), out=sums[1:])
    inverse = pow(_WORD_BASE, -1, 1 << 64)
    return mix((sums[length:] - sums[:-length]) * powers(inverse, n - length + 1) + np.uint64(seed))


def window_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """128 bits of BLAKE2b over the words of each window that starts at a word of ``at`` (ascending), as rows of two numbers.

    Words hold no blank, so joined by one they stand for the window alone.
    """
    out = []
    raw = memoryview(np.ascontiguousarray(data))
    for run in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1):
        if not len(run):
            continue
        a, b = int(run[0]), int(run[-1]) + length
        text = b" ".join([raw[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)])
        sizes = ends[a:b] - starts[a:b]
        begins = np.cumsum(np.r_[0, sizes[:-1] + 1])
        stops = (begins + sizes)[length - 1 :].tolist()
        out += [blake2b(text[s:e], digest_size=16).digest() for s, e in zip(begins[: len(stops)].tolist(), stops, strict=True)]
    return np.frombuffer(b"".join(out), dtype=np.uint64).reshape(-1, 2)


def runs_inside(first: np.ndarray, total: int, length: int) -> np.ndarray:
    """For each of ``total`` words whether a run of ``length`` words that starts there stays in its row."""
    counts = np.diff(first)
    left = np.repeat(first[1:], counts) - np.arange(total)
    return left >= length


def covered(marks: np.ndarray, before: int, after: int) -> np.ndarray:
    """Which positions lie in [m - before, m + after] of a marked position m."""
    n = len(marks)
    at = np.flatnonzero(marks)
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, np.maximum(at - before, 0), 1)
    np.add.at(delta, np.minimum(at + after + 1, n), -1)
    return np.cumsum(delta[:n]) > 0
