"""Substring dedup: remove word runs that occur twice, found by difference-cover anchors.

A difference cover D of the residues modulo v has, for any two positions i and j, an offset d < v with both
i + d and j + d on cover positions (residue in D). So two equal windows of W words share an aligned anchor of
W - v + 1 words, although only |D|/v of all positions are hashed (here v = 21, |D| = 5: 24 %). Anchors that
occur once in the corpus rule out all windows that contain no other; the rest are extended to the whole window,
and whole windows that occur twice mark their words for removal.

An anchor's hash is a 64-bit rolling one and only a filter: two anchors of equal hash cost work, never words. Whole windows are
compared by 128 bits of BLAKE2b over their words, so what is removed does not rest on the rolling hash.

Shape of the job: rows are dealt into blocks of bounded bytes by a hash of the row. Each block reports each of its
distinct hashes once (with a flag if it has it twice), packed into one binary per hash range; ranges compare the
blocks' reports and answer with a bit for each hash of a report. So a passage in a third of all rows costs one entry per
block, no group of copies ever meets in one task, and pairs are never formed.

Defined cases: a null or empty text has no words, nothing is removed and the kept text is empty; texts under W words
keep all words; a very long text is a block of its own, hashed in pieces; repeated rows remove each other; any column but the two
named is ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.llm import bytewords as bw
from ledgersift.scratch import Scratch

WINDOW = 35
PERIOD = 21
#: A perfect difference set modulo 21.
COVER = (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1
BLOCK_BYTES = 4 << 20

_ANCHOR_SEED = 0x51
#: Numbers of 64 bits in an anchor's hash and in a window's.
_ONE, _TWO = 1, 2
_REPORT = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("twice", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("range", pa.int64()), ("bits", pa.binary())])
_ROW = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())]


def _anchors(texts: pa.ChunkedArray) -> tuple:
    """Bytes and words of the texts, which words start an anchor at a cover position, and those anchors' hashes."""
    data, offsets = bw.flat(texts)
    starts, ends, first = bw.word_bounds(data, offsets)
    at = _on_cover(first, len(starts))
    runs = bw.window_hashes(bw.word_hashes(data, starts, ends), ANCHOR, _ANCHOR_SEED)
    return data, starts, ends, first, at, runs[np.flatnonzero(at)][:, None]


def _on_cover(first: np.ndarray, total: int) -> np.ndarray:
    """Words at cover positions whose anchor stays in the row."""
    place = (np.arange(total) - np.repeat(first[:-1], np.diff(first))) % PERIOD
    member = np.zeros(PERIOD, dtype=bool)
    member[list(COVER)] = True
    return member[place] & bw.runs_inside(first, total, ANCHOR)


def _numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hash (a row) a number that equal ones share, and how often each number occurs."""
    order = np.lexsort(hashes.T)
    laid = hashes[order]
    new = np.ones(len(laid), dtype=bool)
    new[1:] = (laid[1:] != laid[:-1]).any(axis=1)
    number = np.empty(len(laid), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return number, np.bincount(number)


def _dealt(found: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes by range, whether each occurs twice, its range, and where each of ``found`` is among them: the same for the same set of hashes."""
    number, counts = _numbered(found)
    once = np.zeros(len(counts), dtype=np.int64)
    once[number] = np.arange(len(number))
    which = (bw.mix(found[once, 0] ^ np.uint64(0x5DEECE66D)) % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(which, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return found[once][order], counts[order] > 1, which[order], place[number]


def _report(block: int, found: np.ndarray, ranges: int) -> pa.Table:
    """The block's distinct hashes, packed by range, with a bit for those that it has twice."""
    hashes, twice, which, _ = _dealt(found, ranges)
    begins = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else np.zeros(0, np.int64)
    stops = np.r_[begins[1:], len(which)] if len(which) else begins
    pieces = [(int(which[a]), block, hashes[a:b].tobytes(), np.packbits(twice[a:b]).tobytes()) for a, b in zip(begins.tolist(), stops.tolist(), strict=True)]
    return pa.table([list(c) for c in zip(*pieces, strict=True)] or [[]] * 4, schema=_REPORT)


def _recurring(width: int):
    """Of one range: for each block, a bit for each hash of its report, set if it occurs twice in all."""

    def answer(reports: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint64).reshape(-1, width) for x in reports["hashes"].to_pylist()]
        twice = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(h)) for t, h in zip(reports["twice"].to_pylist(), hashes, strict=True)]
        number, counts = _numbered(np.concatenate(hashes))
        again = (counts > 1) | (np.bincount(number, np.concatenate(twice)) > 0)
        marks = np.split(again[number], np.cumsum([len(x) for x in hashes])[:-1])
        named = zip(reports["block"].to_pylist(), reports["range"].to_pylist(), marks, strict=True)
        answers = [(block, number, np.packbits(m).tobytes()) for block, number, m in named if m.any()]
        return pa.table([list(c) for c in zip(*answers, strict=True)] or [[]] * 3, schema=_ANSWER)

    return answer


def _answered(found: np.ndarray, answers: pa.Table, ranges: int) -> np.ndarray:
    """Which of the block's hashes occur twice in all, from the answers to its report."""
    hashes, _, which, place = _dealt(found, ranges)
    again = np.zeros(len(hashes), dtype=bool)
    for number, bits in zip(answers["range"].to_pylist(), answers["bits"].to_pylist(), strict=True):
        a, b = np.searchsorted(which, [number, number + 1])
        again[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
    return again[place]


def _kept(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> str:
    raw = data.tobytes()
    return b" ".join([raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]).decode()


def _finish(ids: list, texts: pa.ChunkedArray, gone: np.ndarray | None, bounds: tuple) -> tuple[list, list, list, list]:
    data, starts, ends, first = bounds
    n_words = np.diff(first)
    if gone is None:
        gone = np.zeros(len(starts), dtype=bool)
    removed = np.add.reduceat(np.r_[gone, False].astype(np.int64), first[:-1]) if len(first) > 1 else np.zeros(0, np.int64)
    removed[n_words == 0] = 0
    kept = []
    for k in range(len(n_words)):
        a, b = first[k], first[k + 1]
        kept.append("" if a == b or removed[k] == n_words[k] else _kept_of(data, starts[a:b], ends[a:b], ~gone[a:b]))
    return ids, n_words.tolist(), removed.tolist(), kept


def _kept_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> str:
    lo, hi = int(starts[0]), int(ends[-1])
    return _kept(data[lo:hi], starts - lo, ends - lo, keep)


def strip_repeats(docs: DataFrame, scratch: Scratch, *, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Return ``doc_id, n_words, n_removed, kept_text`` for every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    blocks = size // block_bytes + 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def anchors(table: pa.Table) -> pa.Table:
        return _report(table["block"][0].as_py(), _anchors(table["text"])[-1], blocks)

    def extend(table: pa.Table, answers: pa.Table) -> pa.Table:
        """Rows of the result for texts without a candidate window; else their text, the candidates' places, and the windows' digests."""
        schema = pa.schema([*_ROW, ("text", pa.string()), ("places", pa.binary()), *_REPORT])
        if not table.num_rows:
            return schema.empty_table()
        data, starts, ends, first, at, runs = _anchors(table["text"])
        at[at] = _answered(runs, answers, blocks)
        candidate = bw.covered(at, PERIOD - 1, 0) & bw.runs_inside(first, len(starts), WINDOW)
        report = _report(table["block"][0].as_py(), bw.window_digests(data, starts, ends, np.flatnonzero(candidate), WINDOW), blocks)
        held = np.add.reduceat(np.r_[candidate, False].astype(np.int64), first[:-1]) > 0
        held[np.diff(first) == 0] = False
        done, left = table.filter(pa.array(~held)), table.filter(pa.array(held))
        places = [np.packbits(candidate[a:b]).tobytes() for a, b in zip(first[:-1][held], first[1:][held], strict=True)]
        text_bounds = bw.flat(done["text"])
        result = _finish(done["doc_id"].to_pylist(), done["text"], None, (text_bounds[0], *bw.word_bounds(*text_bounds)))
        parts = [pa.table([pa.array(c, t) for c, (_, t) in zip(result, _ROW, strict=True)], names=[n for n, _ in _ROW])]
        parts.append(pa.table({"doc_id": left["doc_id"], "text": left["text"], "block": left["block"], "places": pa.array(places, pa.binary())}))
        parts.append(report)
        return pa.concat_tables([_shaped(p, schema) for p in parts])

    def strip(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.schema(_ROW).empty_table()
        data, offsets = bw.flat(table["text"])
        starts, ends, first = bw.word_bounds(data, offsets)
        packed = zip(table["places"].to_pylist(), np.diff(first).tolist(), strict=True)
        twice = np.concatenate([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p, n in packed]).astype(bool)
        twice[twice] = _answered(bw.window_digests(data, starts, ends, np.flatnonzero(twice), WINDOW), answers, blocks)
        gone = bw.covered(twice, 0, WINDOW - 1)
        result = _finish(table["doc_id"].to_pylist(), table["text"], gone, (data, starts, ends, first))
        return pa.table([pa.array(c, t) for c, (_, t) in zip(result, _ROW, strict=True)], names=[n for n, _ in _ROW])

    report = "range long, block long, hashes binary, twice binary"
    answer = "block long, range long, bits binary"
    row = "doc_id long, n_words long, n_removed long, kept_text string"
    by_block = dealt.groupBy("block")
    anchored = by_block.applyInArrow(anchors, report).groupBy("range").applyInArrow(_recurring(_ONE), answer)
    mid = scratch.save(
        dealt.groupBy("block").cogroup(anchored.groupBy("block")).applyInArrow(extend, f"{row}, text string, places binary, {report}"), "extended"
    )
    done = mid.filter(F.col("n_words").isNotNull()).select("doc_id", "n_words", "n_removed", "kept_text")
    open_rows = mid.filter(F.col("n_words").isNull() & F.col("range").isNull()).select("doc_id", "text", "places", "block")
    windows = mid.filter(F.col("range").isNotNull()).select("range", "block", "hashes", "twice")
    answers = windows.groupBy("range").applyInArrow(_recurring(_TWO), answer)
    stripped = open_rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(strip, row)
    return done.unionByName(stripped)


def _shaped(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """The table with all of the schema's columns, null where it has none."""
    return pa.table([table[f.name].cast(f.type) if f.name in table.column_names else pa.nulls(table.num_rows, f.type) for f in schema], schema=schema)


