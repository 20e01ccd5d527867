"""WARC archives in Zstandard: one frame per record, a dictionary in the leading skippable frame.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself plain or compressed; each record that
follows is a frame of its own, so a record can be read without those before it. The reader loads the dictionary,
decodes frame by frame and refuses an archive whose version line, required headers, content length, closing
blank lines or digests do not hold.

Writing is split over the executors: each task trains a dictionary from the first records of each archive (at most
``sample_records``), writes archives of about ``archive_bytes`` into the shared folder under names that no other attempt uses, and returns
their names; only archives in that written manifest are read, so a lost or repeated task leaves no record twice. Tasks write through Arrow's file
systems; where Arrow does not know the folder's scheme, the same archives are rows ``name, content`` of a table that Spark writes there.

Records with equal payloads: the smallest page_id is the response, the others are revisits, whose block has the
HTTP headers (with the full length) but no body. The grouping sends one row per payload through the shuffle, and the join back splits hot payloads.
A record's id is its own, from its archive's name and its place there; the page_id has a header, and a revisit names the page and target that it refers to.

Defined cases: null html is an empty payload and takes part like any other; a very long page is a record, and may be an archive, of its own; a row with
a null page_id is a response; rows repeated with the smallest page_id are all responses; null url leaves the target out; control characters in a url are
percent-encoded; an empty table makes no archive and no row; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersift.llm.workers import tidy
from ledgersift.scratch import Scratch
from ledgersift.skew import join_per_key

#: Fixed values of the format.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
ZSTD_DICTIONARY = 0xEC30A437
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 16 << 10
SAMPLE_RECORDS = 200
SAMPLE_BYTES = 1 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
MIN_REVISIT_BYTES = 0

#: Schemes of Hadoop's file systems that Arrow knows by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "file": "file"}

RECORD_FIELDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


class WarcError(ValueError):
    """An archive that breaks the format."""


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None = None, record_id: str = "single") -> bytes:
    """A whole record, with the blank lines that close it."""
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:record:{record_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_clean(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
    ]
    if refers_to is not None:
        lines += [f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Refers-To-Date: {DATE}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        lines += [f"WARC-Refers-To-Target-URI: {_clean(refers_url)}"] if refers_url is not None else []
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8").split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"not a WARC version line: {lines[0][:40]!r}")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"not a header: {line[:60]!r}")
        out[name] = value.strip()
    if missing := [h for h in REQUIRED if h not in out]:
        raise WarcError(f"headers missing: {missing}")
    return out


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; raises `WarcError` if lengths, closing lines or the block's digest do not hold."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found:
        raise WarcError("headers do not end")
    headers = _headers(head)
    if not headers["Content-Length"].isdigit():
        raise WarcError(f"Content-Length {headers['Content-Length']!r}")
    n = int(headers["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {n}, but {len(rest) - 4} bytes or no closing blank lines")
    block = rest[:n]
    if (want := headers.get("WARC-Block-Digest")) and want != f"sha1:{digest_of(block)}":
        raise WarcError("block digest differs")
    return headers, block


def page_of(headers: dict[str, str], block: bytes) -> tuple:
    """The fields of `RECORD_FIELDS` of a response or revisit record."""
    http, found, body = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    if not found or "Content-Length" not in fields:
        raise WarcError("HTTP headers do not end or have no length")
    kind, length, digest = headers["WARC-Type"], int(fields["Content-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(body) != length or digest_of(body) != digest):
        raise WarcError("payload length or digest differs")
    if kind == "revisit" and body:
        raise WarcError("a revisit has a payload")
    page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
    if (refers is None) != (kind == "response"):
        raise WarcError("a revisit refers to a page, a response to none")
    body = body if kind == "response" else None
    return int(page) if page is not None else None, headers.get("WARC-Target-URI"), kind, digest, length, int(refers) if refers is not None else None, body


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from the samples; their raw bytes where there are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:].ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def pack(records: list[bytes], squeeze_dictionary: bool = True) -> bytes:
    """An archive of the records."""
    samples, size = [], 0
    for r in records[:SAMPLE_RECORDS]:
        if size + len(r) > SAMPLE_BYTES and samples:
            continue
        samples.append(r[:SAMPLE_BYTES])
        size += len(samples[-1])
    words = train(samples)
    plain = words.as_bytes()
    stored = zstandard.ZstdCompressor().compress(plain) if squeeze_dictionary else plain
    squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=words)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(stored)), stored, *map(squeeze.compress, records)])


def unpack(archive: bytes | memoryview, piece: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive, one frame each."""
    data = memoryview(archive)
    if len(data) < 8:
        raise WarcError("too short for an archive")
    magic, size = struct.unpack("<II", data[:8])
    if magic != DICTIONARY_FRAME or 8 + size > len(data):
        raise WarcError(f"no dictionary in a leading skippable frame: magic {magic:#x}, {size} of {len(data)} bytes")
    stored = bytes(data[8 : 8 + size])
    if stored[:4] == struct.pack("<I", ZSTD_FRAME):
        stored = zstandard.ZstdDecompressor().decompress(stored, max_output_size=64 << 20)
    words = zstandard.ZstdCompressionDict(stored, dict_type=zstandard.DICT_TYPE_FULLDICT if stored[:4] == struct.pack("<I", ZSTD_DICTIONARY) else zstandard.DICT_TYPE_RAWCONTENT)
    reader, at = zstandard.ZstdDecompressor(dict_data=words), 8 + size
    while at < len(data):
        frame, out = reader.decompressobj(), []
        try:
            while not frame.eof:
                if at >= len(data):
                    raise WarcError("a frame is cut off")
                fed = data[at : at + piece]
                out.append(frame.decompress(fed))
                at += len(fed) - len(frame.unused_data)
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame is damaged: {e}") from e
        yield b"".join(out)


def opened(folder: str) -> tuple[pafs.FileSystem, str] | None:
    """Arrow's file system of a folder and the path there; none where Arrow cannot open it."""
    scheme, mark, rest = folder.partition("://")
    try:
        return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}" if mark else folder)
    except (pa.ArrowException, OSError, ImportError):
        return None


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, *, archive_bytes: int = ARCHIVE_BYTES, as_files: bool = True) -> DataFrame:
    """Write ``page_id, url, html, refers_to, refers_url`` as archives into ``folder``; returns the manifest ``name, records, bytes``.

    Without ``as_files`` the archives are in the manifest too, as ``content``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(folder) if as_files else (None, "")
        if files:
            files.create_dir(root, recursive=True)
        task = TaskContext.get()
        held: list[bytes] = []
        size = turn = 0
        name = lambda: f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{turn:05d}"

        def flush() -> pa.RecordBatch:
            body, file = pack(held), f"{name()}.warc.zst"
            if files:
                with files.open_output_stream(f"{root}/{file}", compression=None) as out:
                    out.write(body)
            return pa.record_batch([[file], [len(held)], [len(body)], pa.array([None if files else body], pa.binary())], names=["name", "records", "bytes", "content"])

        for batch in batches:
            for page, url, html, refers, target in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to", "refers_url")), strict=True):
                record = make_record(page.as_py(), url.as_py(), (html.as_py() or "").encode(), refers.as_py(), target.as_py(), f"{name()}-{len(held)}")
                held.append(record)
                size += len(record)
                if size >= archive_bytes:
                    yield flush()
                    held, size, turn = [], 0, turn + 1
        if held:
            yield flush()

    made = pages.select("page_id", "url", "html", "refers_to", "refers_url").mapInArrow(tidy(work), "name string, records long, bytes long, content binary")
    return scratch.save(made.drop("content") if as_files else made, "manifest")


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """Every record of the archives in ``folder`` (those in the manifest, if there is one, and from it if it has them), with the fields of `RECORD_FIELDS`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD_FIELDS.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        packed = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for raw in unpack(content.as_buffer()):
                    headers, block = parse_record(raw)
                    if headers["WARC-Type"] in ("response", "revisit"):
                        rows.append(page_of(headers, block))
                        size += len(raw)
                    if size > 4 << 20:
                        yield packed(rows)
                        rows, size = [], 0
                if rows:
                    yield packed(rows)

    if manifest is not None and "content" in manifest.columns:
        return manifest.select("content").mapInArrow(tidy(work), RECORD_FIELDS)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    if manifest is not None:
        files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(manifest.select("name"), "name", "left_semi")
    return files.select("content").mapInArrow(tidy(work), RECORD_FIELDS)


def archive_pages(pages: DataFrame, scratch: Scratch, *, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write every page as a record, with revisits of equal payloads, and read all of them back."""
    spark = pages.sparkSession
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumns({"sha": F.sha1(F.encode("html", "UTF-8")), "length": F.octet_length("html"), "other": F.xxhash64("html")})
    keys = ["sha", "length", "other"]
    total = pages.count()
    groups = keyed.groupBy(*keys).agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("copies")).filter((F.col("copies") > 1) & (F.col("length") >= min_bytes))
    known = join_per_key(keyed, scratch.save(groups, "groups"), keys, "copies", total)
    later = F.col("page_id") > F.col("first.page_id")
    folder = scratch.path("archives")
    marked = known.select("page_id", "url", "html", F.when(later, F.col("first.page_id")).alias("refers_to"), F.when(later, F.col("first.url")).alias("refers_url"))
    manifest = write_archives(marked, folder, scratch, as_files=opened(folder) is not None)
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORD_FIELDS)
    return read_archives(spark, folder, manifest)
