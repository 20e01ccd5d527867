"""Random inputs for the parts that run without Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgersift.llm import bytewords, html, langid, media, simhash, warc
from tests.llm import brute

WORDS = st.lists(st.lists(st.sampled_from(["a", "b", "é", "ab", "ÅÄ", "1,"]), max_size=40).map(" ".join), min_size=1, max_size=5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=6))
def test_words_of_any_text(texts):
    data, offsets = bytewords.flat(pa.array(texts, pa.string()))
    starts, ends, first = bytewords.word_bounds(data, offsets)
    raw = data.tobytes()
    assert [[raw[s:e].decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(first, first[1:], strict=False)] == [brute.PLAIN.findall(t or "") for t in texts]


@settings(max_examples=60, deadline=None)
@given(WORDS)
def test_equal_windows_have_equal_hashes_and_no_others(texts):
    data, offsets = bytewords.flat(pa.array(texts))
    starts, ends, first = bytewords.word_bounds(data, offsets)
    hashes = bytewords.window_hashes(bytewords.word_hashes(data, starts, ends), 4, 3)
    inside = bytewords.runs_inside(first, len(starts), 4)
    raw, seen = data.tobytes(), {}
    for i in np.flatnonzero(inside):
        seen.setdefault(tuple(raw[s:e] for s, e in zip(starts[i : i + 4], ends[i : i + 4], strict=True)), set()).add(int(hashes[i]))
    assert all(len(v) == 1 for v in seen.values()) and len({h for v in seen.values() for h in v}) == len(seen)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=50), st.integers(0, 5), st.integers(0, 5))
def test_covered(marks, before, after):
    got = bytewords.covered(np.array(marks), before, after).tolist()
    assert got == [any(marks[max(0, i - after) : i + before + 1]) for i in range(len(marks))]


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=300))
def test_fingerprint_of_any_text(text):
    assert simhash.fingerprint(text) == brute.simhash(text)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_media_round_trip(payload):
    full = media.pad(payload)
    assert len(full) % media.UNIT == 0 and full and media.decode(media.encode(full)).tobytes() == full


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 9)), st.one_of(st.none(), st.text(max_size=20)), st.binary(max_size=200)), min_size=1, max_size=8))
def test_archive_round_trip(pages):
    records = [warc.make_record(p, u, b, None) for p, u, b in pages]
    got = [warc.page_of(*warc.parse_record(r)) for r in warc.unpack(warc.pack(records))]
    assert [(g[0], g[6]) for g in got] == [(p, b) for p, _, b in pages]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<article>", "</article>", "<li>", "<td>", "<nav>", "</nav>", "<b", ">", "&amp;", "&#x", "word", "two words", "\n", "<!--", "-->", "<script>", "</script>", "<br/>"]), max_size=40).map("".join))
def test_extraction_never_fails(page):
    text = html.extract(page)
    assert text == "\n".join(line.strip() for line in text.split("\n")) and "\n\n" not in text


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="abÉ ü\n.1", max_size=200))
def test_language_counts_agree_with_the_batch(text):
    which, often = langid.counts(text)
    model = langid.LanguageModel(["x"], np.arange(langid.BUCKETS, dtype=float)[:, None] * 1e-4, np.zeros(1), 1.0, 0.0)
    data, offsets = bytewords.flat(pa.array([text, "b"]))
    padded, begins = langid._padded(data, offsets)
    total = sum(model.table[b[(a >= begins[0]) & (a < begins[1])], 0].sum() for b, a in (langid._grams(padded, n) for n in langid.ORDERS))
    assert np.isclose(total, often @ model.table[which][:, 0])
