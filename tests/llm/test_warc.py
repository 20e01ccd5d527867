"""Record ids are unique, revisits name their target, and a folder that Arrow cannot open makes no difference."""

from __future__ import annotations

import pytest

from ledgersift.llm import warc
from ledgersift.scratch import Scratch

PAGES = [(i % 7 if i % 5 else None, f"http://a/{i}", f"<p>{i % 3}</p>") for i in range(60)] + [(1, "http://b", "x" * 3_000_000), (2, "http://c", "x" * 3_000_000)]


def test_record_ids_are_unique(spark):
    frame = spark.createDataFrame([(*p, None, None) for p in PAGES], "page_id long, url string, html string, refers_to long, refers_url string")
    scratch = Scratch(spark, "t")
    manifest = warc.write_archives(frame, scratch.path("archives"), scratch, archive_bytes=2000)
    files, root = warc.opened(scratch.path("archives"))
    ids = []
    for r in manifest.collect():
        with files.open_input_stream(f"{root}/{r.name}", compression=None) as f:
            ids += [warc.parse_record(raw)[0]["WARC-Record-ID"] for raw in warc.unpack(f.read())]
    assert len(ids) == len(PAGES) == len(set(ids))


def test_revisits_name_what_they_refer_to():
    headers, block = warc.parse_record(warc.make_record(5, "http://a", b"body", 2, "http://first"))
    assert headers["WARC-Refers-To-Target-URI"] == "http://first" and warc.page_of(headers, block)[5] == 2
    with pytest.raises(warc.WarcError, match="refers"):
        warc.page_of(headers | {"WARC-Type": "response"}, warc.parse_record(warc.make_record(5, "u", b"body", None))[1])


def test_other_file_systems(spark, monkeypatch):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    want = sorted(warc.archive_pages(frame, Scratch(spark, "t")).collect(), key=repr)
    assert warc.opened("viewfs://cluster/folder") is None and warc.opened("file:///tmp") is not None
    monkeypatch.setattr(warc, "opened", lambda folder: None)
    assert sorted(warc.archive_pages(frame, Scratch(spark, "t")).collect(), key=repr) == want
