"""Each operator against its brute-force version, on edge cases and on the whole small table."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgersift.llm import bytewords, decontam, html, langid, media, mixing, quality, sharding, simhash, substring, warc
from ledgersift.llm.queries import QUERIES
from ledgersift.scratch import Scratch
from tests.llm import brute

RNG = random.Random(5)
VOCAB = [a + b for a in "bdfgklmnprst" for b in ("a", "é", "i", "O", "ußt", "Éa")]


def _prose(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


PASSAGE = _prose(60)
LONG = _prose(30_000)
DOCS = [
    (1, _prose(200), "en", "b", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n ", "de", "a", 3),
    (5, _prose(50) + " " + PASSAGE + "\n" + _prose(70), "en", "a", 9),
    (6, PASSAGE, None, "é", 9),
    (7, _prose(11) + "\t" + PASSAGE.replace(" ", "\r\n") + " " + PASSAGE, "en", None, 2),
    (8, LONG, "fr", "hot", 7),
    (9, LONG + " tail", "fr", "hot", 7),
    (10, _prose(5), "en", "hot", 1),
    (10, _prose(5), "en", "hot", 1),
    (11, "12 34 !!", "xx", "hot", 1),
    (None, _prose(40), "en", "hot", 1),
    (None, None, None, "hot", 1),
    (12, "ba ba ba", "en", "z", 1),
    (13, "la " * 400, "en", "z", 1),
]
ITEMS = [(1, " ".join(PASSAGE.split()[5:25])), (2, "BA fOO"), (3, None), (4, ""), (None, PASSAGE[:200]), (20, PASSAGE), (5, _prose(30)), (6, "la la la la la la la la la la la la"), (2, "again ba")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*d, "x", "y") for d in DOCS] + [(*DOCS[0], "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, fp string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def _pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def _sorted(rows):
    return sorted([tuple(r) for r in rows], key=repr)


def _check_decontam(spark, docs, items, frame):
    got = decontam.contamination(frame, items, Scratch(spark, "t")).select("doc_id", "n_words", "n_hit", "items").collect()
    want = brute.decontaminate(_pairs(frame), [(r.item_id, r.text) for r in items.collect()])
    assert _sorted(got) == _sorted(want)


def test_decontamination(spark, docs, none, sf_dir):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    _check_decontam(spark, docs, items, docs)
    assert decontam.contamination(none, items, Scratch(spark, "t")).count() == 0
    _check_decontam(spark, docs, items.filter("false"), docs)
    _check_decontam(spark, docs, items.filter("item_id = 4"), docs)
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _check_decontam(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), whole)


def test_decontamination_shuffled_join_agrees(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    one = decontam.contamination(docs, items, Scratch(spark, "t"), broadcast_rows=0).collect()
    assert _sorted(one) == _sorted(decontam.contamination(docs, items, Scratch(spark, "t")).collect())


def test_archives_round_trip(spark):
    pages = [(1, "http://a/1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://a/\r\nX: y", None), (4, "u", ""), (5, "é", "ü" * 100_000), (None, "n", "<p>x</p>"), (None, "n", "only"), (0, "z", "ü" * 100_000), (7, "a", "p"), (7, "a", "p"), (8, "a", "p")]
    frame = spark.createDataFrame([(*p, 1, "q") for p in pages], "page_id long, url string, html string, sha int, record_type string")
    got = warc.archive_pages(frame, Scratch(spark, "t"))
    assert _sorted(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == _sorted(brute.revisits([(p, h) for p, _, h in pages]))
    bodies = {r.page_id: r.payload for r in got.filter("record_type = 'response' and page_id is not null").collect()}
    assert bytes(bodies[0]).decode() == "ü" * 100_000 and bytes(bodies[3]) == b""
    assert warc.archive_pages(frame.filter("false"), Scratch(spark, "t")).count() == 0


def test_archives_of_the_table(spark, sf_dir):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = QUERIES["op2_warc"](spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert _sorted(got) == _sorted(brute.revisits(pages))


@pytest.mark.parametrize("plain", [True, False])
def test_archive_faults(plain):
    records = [warc.make_record(i, f"http://a/{i}", b"<p>%d</p>" % i * 40, None) for i in range(120)]
    archive = warc.pack(records, squeeze_dictionary=plain)
    assert list(warc.unpack(archive)) == records
    with pytest.raises(warc.WarcError, match="cut off|damaged"):
        list(warc.unpack(archive[:-3]))
    with pytest.raises(warc.WarcError, match="dictionary"):
        list(warc.unpack(b"\x00" * 40))
    with pytest.raises(warc.WarcError, match="Content-Length"):
        warc.parse_record(records[0].replace(b"<p>0</p>", b"<p>0</p>!", 1))
    with pytest.raises(warc.WarcError, match="digest"):
        warc.parse_record(records[0].replace(b"<p>0</p>", b"<p>1</p>", 1))
    with pytest.raises(warc.WarcError, match="missing"):
        warc.parse_record(records[0].replace(b"WARC-Date", b"WARC-Dat_", 1))


def test_media(spark, docs, none):
    stored = media.store_media(docs, Scratch(spark, "t"))
    got = media.media_features(stored).collect()
    want = []
    for i, t in _pairs(docs):
        body = (t or "").encode()
        full = body + b"\xff" * (-len(body) % 576 or (0 if body else 576))
        want.append((i, len(body), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])))
    assert _sorted([tuple(r)[:5] for r in got]) == _sorted(want)
    assert all(len(r.feature) == 16 for r in got) and media.media_features(media.store_media(none, Scratch(spark, "t"))).count() == 0
    by = {}
    for r in got:
        by.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by.values())


def test_png_filters_and_faults():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 256, (48, 24)).astype(np.uint8)
    assert (media.decode(media.encode(rows.tobytes())) == rows).all()
    kinds = rng.integers(0, 5, 48).astype(np.uint8)
    lines = np.zeros_like(rows)
    for r in range(48):
        for c in range(24):
            a, b = int(rows[r, c - 1]) if c else 0, int(rows[r - 1, c]) if r else 0
            d = int(rows[r - 1, c - 1]) if c and r else 0
            p = a + b - d
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
            lines[r, c] = (int(rows[r, c]) - [0, a, b, (a + b) // 2, paeth][kinds[r]]) % 256
    assert (media.unfilter(kinds, lines) == rows).all()
    good = media.encode(rows.tobytes())
    for bad in (good[:-1], good[:60] + bytes([good[60] ^ 1]) + good[61:], b"x" + good[1:]):
        with pytest.raises(media.MediaError):
            media.decode(bad)
    near = rows.copy()
    near[3, 3] ^= 1
    distance = (int(media.cosine_hash(rows), 16) ^ int(media.cosine_hash(near), 16)).bit_count()
    assert distance <= 8


def test_substring(spark, docs, none, sf_dir):
    for frame in (docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        want = brute.strip_repeats(_pairs(frame))
        for size in (4 << 20, 20_000):
            got = substring.strip_repeats(frame, Scratch(spark, "t"), block_bytes=size).collect()
            assert _sorted(got) == _sorted(want)
    assert substring.strip_repeats(none, Scratch(spark, "t")).count() == 0


def test_difference_cover():
    for i in range(substring.PERIOD):
        for j in range(substring.PERIOD):
            assert any((i + d) % substring.PERIOD in substring.COVER and (j + d) % substring.PERIOD in substring.COVER for d in range(substring.PERIOD))


def test_byte_words():
    texts = ["a bb  ccc", None, "", " x\ty\x0bz ", "one", "über Ä\x1f"]
    data, offsets = bytewords.flat(pa.array(texts))
    starts, ends, first = bytewords.word_bounds(data, offsets)
    raw = data.tobytes()
    got = [[raw[s:e].decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(first, first[1:], strict=False)]
    assert got == [brute.PLAIN.findall(t or "") for t in texts]
    hashes = bytewords.word_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(hashes)
    again = bytewords.flat(pa.array(["zz bb one"]))
    assert set(bytewords.word_hashes(again[0], *bytewords.word_bounds(*again)[:2]).tolist()) & set(hashes.tolist())


def test_simhash(spark, docs, none, sf_dir):
    for frame in (docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = [(i, brute.simhash(t)) for i, t in _pairs(frame)]
        want = [(i, f, c) for (i, f), c in zip(rows, brute.components(rows), strict=True)]
        for limit in (4096, 2):
            got = simhash.near_duplicates(frame, Scratch(spark, "t"), shard_limit=limit).collect()
            assert _sorted((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == _sorted(want)
    assert simhash.near_duplicates(none, Scratch(spark, "t")).count() == 0


def test_bk_tree_finds_every_neighbour():
    rng = np.random.default_rng(3)
    codes = np.unique(np.concatenate([rng.integers(0, 2**63, 300).astype(np.uint64), (np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)))]))
    rng.shuffle(codes)
    tree, order = simhash.BKTree.plant(codes)
    assert sorted(order.tolist()) == list(range(len(codes))) and (tree.codes == codes[order]).all()
    found = {(int(order[n]), int(q)) for n, near in tree.search(codes, 2) for q in near}
    want = {(i, j) for i in range(len(codes)) for j in range(len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 2}
    assert found == want
    label = simhash.local_links(tree, 0, len(codes))
    assert len(set(label.tolist())) == len(set(brute.components(list(enumerate(map(int, codes))))))


def test_mixing(spark, docs, none, sf_dir):
    for frame in (docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = frame.collect()
        sizes = {}
        for r in rows:
            sizes[r.source] = sizes.get(r.source, 0) + len(brute.PLAIN.findall(r.text or ""))
        targets = brute.targets(sizes)
        want = []
        for r in rows:
            n, rate = len(brute.PLAIN.findall(r.text or "")), targets[r.source] / sizes[r.source] if sizes[r.source] else 0.0
            copies = math.floor(rate) + (brute.draw(r.doc_id, r.text) < rate - math.floor(rate))
            want.append((r.doc_id, n, sizes[r.source], round(targets[r.source], 6), copies))
        plan = mixing.mixing_plan(frame, Scratch(spark, "t"))
        got = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.copies) for r in plan.collect()]
        assert _sorted(got) == _sorted(want)
        mixed = mixing.mix(frame, Scratch(spark, "t"))
        assert mixed.columns == frame.columns and mixed.count() == sum(w[4] for w in want)
    assert mixing.mix(none, Scratch(spark, "t")).count() == 0


def test_hilbert_index_is_the_curve(spark):
    cells = [(x, y, z) for x in range(8) for y in range(8) for z in range(8)]
    frame = spark.createDataFrame(cells, "x long, y long, z long").withColumn("h", sharding.hilbert_index([F.col("x"), F.col("y"), F.col("z")], 3))
    got = {r.h: (r.x, r.y, r.z) for r in frame.collect()}
    assert got == {brute.hilbert(c, 3): c for c in cells}
    assert all(sum(abs(a - b) for a, b in zip(got[i], got[i + 1], strict=True)) == 1 for i in range(511))


def test_sharding(spark, docs, none, sf_dir):
    for frame in (docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        got = sharding.shard(frame, Scratch(spark, "t")).collect()
        bodies = [(i, (t or "").encode()) for i, t in _pairs(frame)]
        assert _sorted(r[:3] for r in got) == _sorted((i, len(b) + 1, zlib.crc32(b)) for i, b in bodies)
        by = {}
        for r in got:
            by.setdefault(r.shard, []).append(r.slot)
        counts = [len(by.get(s, [])) for s in range(16)]
        assert set(by) <= set(range(16)) and max(counts) - min(counts) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        ordered = [r.hilbert for r in sorted(got, key=lambda r: (r.shard, r.slot))]
        assert ordered == sorted(ordered)
        again = sharding.shard(frame.repartition(7), Scratch(spark, "t")).collect()
        assert _sorted(again) == _sorted(got)
    assert sharding.shard(none, Scratch(spark, "t")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body class="has-sidebar"><nav><a href=/>Home</a></nav>
<div class="ad">Buy now</div>%s<h1>Head &amp; line</h1><p>First   para with <b>bold</b>
text and more of it.<br>Second line &eacute;.<p>Be.</p><ul><li>One<li>Two</ul><form>mail <input></form><aside>Related</aside>
<section id="comments"><p>Reader says hi, at some length, so that it is a long line of text.</p></section>%s<footer>&copy; me</footer></body></html>"""
MAIN = "Head & line\nFirst para with bold text and more of it.\nSecond line é.\nBe.\nOne\nTwo"


@pytest.mark.parametrize("around", [("<article>", "</article>"), ("<main>", "</main>"), ("<div id=content>", "</div>"), ("", "")])
def test_html_extraction(around):
    assert html.extract(PAGE % around) == MAIN


def test_html_regions():
    far = "<div><p>" + "Long words elsewhere on the page. " * 20 + "</p></div>"
    post = "<article class='post has-sidebar'><h1>A</h1><p>b.</p>%s<article class='comment'>Me too</article></article>"
    text = " ".join("Long words elsewhere on the page." for _ in range(20))
    assert html.extract(f"<body><div>x</div>{post % far}<div>y</div></body>") == f"A\nb.\n{text}"
    assert html.extract(f"<body>{far}{post % ''}{far}</body>") == f"{text}\n{text}"  # the seeds decide, not the one article's name
    two = "<main><article><p>one and more</p></article><article><p>two and more</p></article></main>"
    assert html.extract(f"<body><p>x</p>{two}</body>") == "one and more\ntwo and more"
    assert html.extract("<body><div class='cookie-notice'>We use</div><div id='siteMenu'>Home</div><div><p>Body text here</p><p>More</p></div><p class=copyright>c</p></body>") == "Body text here\nMore"


def test_html_edge_cases(spark, sf_dir):
    assert html.extract(None) == html.extract("") == html.extract("<nav>x</nav>") == ""
    assert html.extract("just words") == "just words"
    assert html.extract("</div></p>a<p>b") == "a\nb"
    assert html.extract("<p>" + "word " * 100_000 + "</p>") == ("word " * 100_000).strip()
    frame = spark.createDataFrame([(1, None, None, 1), (1, "u", "<p>a", 2), (None, "u", "", 3)], "page_id long, url string, html string, text int")
    assert _sorted(html.main_text(frame).collect()) == _sorted([(1, None, ""), (1, "u", "a"), (None, "u", "")])
    assert html.main_text(frame.filter("false")).count() == 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = r.html.partition("<article>")[2].partition("</article>")[0]
        assert html.extract(r.html) == html.extract(f"<body>{inner}</body>") and "track(" not in html.extract(r.html)


def test_language(spark, docs, none, sf_dir):
    whole = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(whole)
    rows = langid.predict(whole, model).select("doc_id", "lang", "language.*").toDF("doc_id", "truth", "lang", "score", "rejected").collect()
    held = [r for r in rows if brute.held_out(r.doc_id)]
    assert sum(r.truth == r.lang for r in held) / len(held) >= 0.97
    assert sum(r.rejected for r in rows) / len(rows) < 0.02 and all(0 <= r.score <= 1 for r in rows)
    got = langid.predict(docs, model).collect()
    assert all((r.language.lang == "und") == (not any(map(str.isalpha, r.text or ""))) for r in got)
    assert all(r.language.rejected for r in got if r.language.lang == "und")
    assert langid.predict(none, langid.train(none)).count() == 0
    assert {r.language.lang for r in langid.predict(docs, langid.train(none)).collect()} == {"und"}


def test_language_pieces_agree():
    text = " ".join(VOCAB * 3000)
    model = langid.fit([("a", *langid.counts("das ist ein haus")), ("b", *langid.counts("the house is red"))] * 20)
    one = model.predict(pa.array([text, "das haus"]))
    often = langid.counts(text)
    assert np.allclose(model.scores((often[1] @ model.table[often[0]])[None, :], np.array([often[1].sum()])).max(), one[1][0])


def test_quality(spark, docs, none):
    base = "/root/testdata/sf0.1"
    frame, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = quality.train(frame, labels)
    assert model.thresholds[0] < model.thresholds[1]
    truth = {r.doc_id: 0 if r.toxic else 1 if not r.quality else 2 for r in labels.collect() if brute.held_out(r.doc_id)}
    got = {r.doc_id: r for r in quality.grade(frame, model).collect()}
    chosen = {k: np.mean([got[i].selected for i, g in truth.items() if g == k]) for k in range(3)}
    expected = {k: np.mean([got[i].expected_grade for i, g in truth.items() if g == k]) for k in range(3)}
    assert chosen[2] > 0.95 and chosen[0] < 0.3 and chosen[1] < 0.4 and expected[0] < expected[1] < expected[2]
    insult = [r.doc_id for r in frame.collect() if {"idiot", "moron", "scum"} & set(r.text.lower().split()) and brute.held_out(r.doc_id)]
    assert np.mean([got[i].selected for i in insult]) < 0.1
    rows = quality.grade(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.expected_grade <= 2 and r.p_top <= r.p_not_toxic for r in rows)
    assert quality.grade(none, quality.train(none, labels)).count() == 0
    odd = spark.createDataFrame([(1, None, 1), (1, 1, None), (None, 1, 1), (3, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.grade(docs, quality.train(docs, odd)).collect()) == docs.count()
