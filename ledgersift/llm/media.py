"""Media columns: bytes as 8-bit grey PNG in a binary column, read back with checks, and cosine-transform hashes.

A payload becomes an image 24 pixels wide; rows are filtered (none, left or up, whichever leaves the smallest differences), deflated,
and laid out in PNG chunks with their CRCs. Reading tests the signature, every chunk's CRC, the header, the size of the inflated data and
the filter types, and undoes the filters with numpy (all five of the format). The image is averaged to 24 x 24 and the lowest 8 x 8
frequencies of its cosine transform, without the constant one, make a 64-bit hash against their median: payloads that differ a little
get hashes that differ in few bits.

Media are a written table in the shared folder, as binary column; features are computed from what is read back. One row is in memory at a time.

Defined cases: null text is an empty payload (padded to 576 bytes of 255); equal texts have equal media and features; ids may repeat or be null;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.workers import tidy
from ledgersift.scratch import Scratch

#: Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 24
UNIT = WIDTH * WIDTH
PAD = 255
LOW = 8
#: Bytes of media in one batch that goes back to Spark.
BATCH_BYTES = 8 << 20


class MediaError(ValueError):
    """Bytes that are not a sound PNG of the kind written here."""


def pad(payload: bytes, unit: int = UNIT) -> bytes:
    """The payload with bytes 255 up to a positive multiple of ``unit``."""
    return payload + bytes([PAD]) * (-len(payload) % unit or (unit if not payload else 0))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(samples: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """A grey 8-bit PNG of the samples, ``width`` to a row."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    left, up = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    tries = np.stack([rows, left, up])
    cost = np.abs(tries.view(np.int8).astype(np.int16)).sum(axis=2)
    kind = cost.argmin(axis=0).astype(np.uint8)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = tries[kind, np.arange(len(rows))]
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undo the row filters 0 to 4 of 8-bit grey rows."""
    if len(kinds) and kinds.max() > 4:
        raise MediaError(f"filter type {kinds.max()}")
    out = lines.copy()
    left = kinds == 1
    out[left] = np.cumsum(out[left], axis=1, dtype=np.uint8)
    change = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip(np.r_[0, change].tolist(), np.r_[change, len(kinds)].tolist(), strict=True):
        if a >= len(kinds):
            break
        kind = int(kinds[a])
        if kind == 2:
            start = max(a - 1, 0)
            out[start:b] = np.cumsum(out[start:b], axis=0, dtype=np.uint8)
        elif kind > 2:
            for r in range(a, b):
                above = out[r - 1].astype(int).tolist() if r else [0] * out.shape[1]
                row, before, corner = [], 0, 0
                for x, top in zip(lines[r].tolist(), above, strict=True):
                    if kind == 3:
                        guess = (before + top) // 2
                    else:
                        p = before + top - corner
                        d = (abs(p - before), abs(p - top), abs(p - corner))
                        guess = before if d[0] <= d[1] and d[0] <= d[2] else top if d[1] <= d[2] else corner
                    before, corner = (x + guess) & 255, top
                    row.append(before)
                out[r] = row
    return out


def decode(media: bytes) -> np.ndarray:
    """The rows of samples of a PNG; raises `MediaError` where anything does not hold."""
    if media[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, chunks = 8, []
    while at < len(media):
        if at + 12 > len(media):
            raise MediaError("a chunk is cut off")
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body, check = media[at + 8 : at + 8 + size], media[at + 8 + size : at + 12 + size]
        if len(check) != 4 or zlib.crc32(kind + body) != struct.unpack(">I", check)[0]:
            raise MediaError(f"checksum of chunk {kind!r}")
        chunks.append((kind, body))
        at += 12 + size
    if len(chunks) < 3 or chunks[0][0] != b"IHDR" or chunks[-1] != (b"IEND", b"") or len(chunks[0][1]) != 13:
        raise MediaError("chunks missing or out of order")
    width, height, *rest = struct.unpack(">IIBBBBB", chunks[0][1])
    if rest != [8, 0, 0, 0, 0] or not width or not height:
        raise MediaError(f"not an 8-bit grey image: {rest}")
    inflate = zlib.decompressobj()
    raw = inflate.decompress(b"".join(b for k, b in chunks if k == b"IDAT"), height * (width + 1) + 1)
    if len(raw) != height * (width + 1) or not inflate.eof:
        raise MediaError("pixel data of the wrong size")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


_BASIS = np.cos(np.pi / WIDTH * (np.arange(WIDTH) + 0.5)[None, :] * np.arange(LOW)[:, None])


def cosine_hash(rows: np.ndarray) -> str:
    """16 hex digits: which of the lowest 8 x 8 frequencies (the constant one is always 0) lie above their median."""
    image = rows.reshape(WIDTH, -1, WIDTH).mean(axis=1)
    low = (_BASIS @ image @ _BASIS.T).round(6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def store_media(docs: DataFrame, scratch: Scratch, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write ``doc_id, n_bytes, media`` and return the written table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: list, sizes: list, media: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

        for batch in batches:
            ids, sizes, media, held = [], [], [], 0
            for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                body = (t.as_py() or "").encode()
                ids.append(i.as_py())
                sizes.append(len(body))
                media.append(encode(pad(body)))
                held += len(media[-1])
                if held > BATCH_BYTES:
                    yield out(ids, sizes, media)
                    ids, sizes, media, held = [], [], [], 0
            if ids:
                yield out(ids, sizes, media)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return scratch.save(rows.mapInArrow(tidy(work), "doc_id long, n_bytes long, media binary"), "media")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """Decode every stored image and compute the columns of `FEATURES`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, n, m in zip(*batch.columns, strict=True):
                stored = m.as_py()
                samples = decode(stored)
                body = samples.tobytes()
                rows.append((i.as_py(), n.as_py(), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(samples)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in FEATURES.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(work), FEATURES)
