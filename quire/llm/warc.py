"""WARC archives compressed with Zstandard: writer, and reader with validation.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself compressed or
not; each record follows as one frame of its own, made with that dictionary. The reader walks a stream of frames one at
a time in small steps, so its time is linear in the archive and it holds one record, and checks: frame magic
and checksum, the version line, mandatory headers, headers that may not repeat, the block's length against Content-Length, the two
line ends after the block, and the block and payload digests.

Archives are rows (archive_id, content): a Parquet table in a store that all executors share, written under Spark's
commit protocol, or files. `read_files` takes whole files from Spark's own reader, whatever the store; `stream_files` opens
those that pyarrow's filesystems reach, and never holds a file. `export` writes .warc.zst files.

A record that breaks the format is a row whose `error` says how; the records after it are read. Where the frames
themselves break off, the archive's last row says so. With strict=True either fails the job instead. The dictionary is trained on
the first 16 KiB of a record at most, which changes sizes only.

Defined cases: a null payload is an empty one; for a null or empty URL `urn:page:<id>` stands in; a row with a null page_id is always a response and never
referred to; rows that share page_id and payload are all of the type that their page_id gives; line ends within a
URL are percent-encoded; an empty table gives no archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import salt_of, salts_in, stored, table

#: Fixed values of the WARC/Zstandard format.
DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MAY_REPEAT = ("warc-concurrent-to",)

REVISIT_LEAST = 100
STEP_BYTES = 4 << 10
ARCHIVE_BYTES = 4 << 20
ARCHIVE_ROWS = 2048
DICT_BYTES = 16 << 10
SAMPLE_BYTES = 512 << 10
SALTS = 48
DATE = "2020-01-01T00:00:00Z"
PAGE_SCHEMA = "page_id long, record_type string, refers_to long, payload binary"
ARCHIVES = "archive_id string, content binary"
RECORDS = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "target_uri string, record_id string, payload binary, error string"
)


class WarcError(ValueError):
    """An archive that breaks the format."""


# Records


def record_id(page_id: int | None, salt: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}{salt}')}>"


def clean_uri(uri: str) -> str:
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in uri)


def sha(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record. A revisit keeps the HTTP head, which still names the payload's length, and no payload."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date),
        ("WARC-Target-URI", clean_uri(url) if url else f"urn:page:{page_id}"), ("WARC-Payload-Digest", sha(payload)),
        ("WARC-Block-Digest", sha(block)), ("Content-Type", "application/http;msgtype=response"),
    ]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def headers(text: bytes, may_repeat: tuple[str, ...] | None = MAY_REPEAT) -> dict[str, str]:
    """By lower-case name. Repeated ones are joined by commas if they may repeat (None: all may), else an error. A line
    that starts with white space goes on the one before."""
    out: dict[str, str] = {}
    last = ""
    for line in text.split(b"\r\n") if text else []:
        if last and line[:1] in (b" ", b"\t"):
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon or not name or name.strip() != name:
            raise WarcError(f"bad header line {line[:80]!r}")
        last = name.lower().decode("latin-1")
        own = value.strip().decode("utf-8", "replace")
        if last in out and may_repeat is not None and last not in may_repeat:
            raise WarcError(f"header {name!r} twice")
        out[last] = f"{out[last]}, {own}" if last in out else own
    return out


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, validated."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, _, lines = head.partition(b"\r\n")
    if not gap or first not in (VERSION, b"WARC/1.0"):
        raise WarcError(f"no WARC record: {first[:20]!r}")
    h = headers(lines)
    if missing := [k for k in MANDATORY if k not in h]:
        raise WarcError(f"no {', '.join(missing)}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes, Content-Length {h['content-length']}")
    block = rest[:-4]
    check_digest(h.get("warc-block-digest"), block)
    return h, block


def check_digest(named: str | None, data: bytes) -> None:
    if named is None:
        return
    kind, _, value = named.partition(":")
    if kind.lower() not in ("sha256", "sha-256", "sha1"):
        raise WarcError(f"digest {kind!r} isn't known")
    own = hashlib.new(kind.lower().replace("-", ""), data)
    if value.lower() != own.hexdigest() and value != base64.b32encode(own.digest()).decode():
        raise WarcError(f"{kind} digest doesn't match")


def page_of(data: bytes) -> tuple:
    """A row of RECORDS. Only blocks of HTTP messages have a head before the payload."""
    h, block = parsed(data)
    kind = h["warc-type"]
    number = lambda k: int(h[k]) if k in h else None
    digest = h.get("warc-payload-digest")
    ids = (h.get("warc-target-uri"), h["warc-record-id"])
    http = kind in ("response", "revisit") and h.get("content-type", "application/http").startswith("application/http")
    if not http:
        payload = block.partition(b"\r\n\r\n")[2] if kind == "request" else block
        check_digest(digest, payload)
        return number("x-page-id"), len(payload), (digest or sha(payload)).partition(":")[2], kind, number("x-refers-to-page-id"), *ids, payload, None
    head, gap, payload = block.partition(b"\r\n\r\n")
    status, _, lines = head.partition(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise WarcError("no HTTP head in the block")
    fields = headers(lines, None)
    named = fields.get("content-length", str(len(payload)))
    if not named.isdigit():
        raise WarcError(f"HTTP Content-Length {named[:40]!r}")
    length = int(named)
    if kind == "response":
        if length != len(payload) and "transfer-encoding" not in fields and "warc-truncated" not in h:
            raise WarcError(f"payload of {len(payload)} bytes, HTTP names {length}")
        check_digest(digest, payload)
        length = len(payload)
    elif payload:
        raise WarcError("a revisit record with a payload")
    return number("x-page-id"), length, (digest or sha(payload)).partition(":")[2], kind, number("x-refers-to-page-id"), *ids, None if kind == "revisit" else payload, None


# Archives


def dictionary(records: list[bytes], dict_bytes: int = DICT_BYTES, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """Trained on evenly spaced records of this archive, of sample_bytes in all at most; empty if that can't be."""
    step = max(1, sum(map(len, records)) // sample_bytes)
    samples = [r[:16384] for r in records[::step]]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(dict_bytes, samples, k=256, d=8, f=18, accel=4).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive(records: list[bytes], level: int = 3) -> bytes:
    trained = dictionary(records)
    out = []
    known = None
    if trained:
        known = zstandard.ZstdCompressionDict(trained)
        packed = zstandard.ZstdCompressor(level=level, write_checksum=True).compress(trained)
        out.append(struct.pack("<II", DICT_MAGIC, len(packed)) + packed)
    c = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True)
    out += [c.compress(r) for r in records]
    return b"".join(out)


class Buffered:
    """Reads a stream in steps, and takes back what was read too far."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.held, self.at = stream, b"", 0

    def some(self, n: int) -> bytes:
        """Up to n bytes: none only at the end."""
        out, self.held = (self.held[:n], self.held[n:]) if self.held else (self.stream.read(n), b"")
        self.at += len(out)
        return out

    def exactly(self, n: int, what: str) -> bytes:
        out = b""
        while len(out) < n:
            more = self.some(n - len(out))
            if not more:
                raise WarcError(f"{what} is cut off at byte {self.at}")
            out += more
        return out

    def back(self, data: bytes) -> None:
        self.held = data + self.held
        self.at -= len(data)


def frames(stream: BinaryIO, step: int = STEP_BYTES) -> Iterator[bytes]:
    """The record of each frame of an archive."""
    source, known = Buffered(stream), None
    while first := source.some(1):
        start = source.at - 1
        magic, size = struct.unpack("<II", first + source.exactly(7, "a frame's head"))
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            body = source.exactly(size, "a skippable frame")
            if magic == DICT_MAGIC and start == 0:
                try:
                    if body[:4] == struct.pack("<I", FRAME_MAGIC):
                        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                    known = zstandard.ZstdCompressionDict(body)
                except (zstandard.ZstdError, ValueError) as e:
                    raise WarcError(f"the dictionary: {e}") from e
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"no frame at byte {start}")
        d = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
        out, more = [], struct.pack("<II", magic, size)
        try:
            while not d.eof and more:
                out.append(d.decompress(more))
                more = b"" if d.eof else source.some(step)
        except zstandard.ZstdError as e:
            raise WarcError(f"the frame at byte {start}: {e}") from e
        if not d.eof:
            raise WarcError(f"the frame at byte {start} is cut off")
        source.back(d.unused_data)
        yield b"".join(out)


def read_stream(stream: BinaryIO, strict: bool = True) -> Iterator[tuple]:
    """Rows of RECORDS; unless strict, also for what breaks the format."""
    failed = lambda e: (*[None] * 8, str(e))
    found = frames(stream)
    while True:
        try:
            data = next(found, None)
        except WarcError as e:
            if strict:
                raise
            yield failed(e)
            return
        if data is None:
            return
        try:
            row = page_of(data)
        except ValueError as e:
            if strict:
                raise
            row = failed(e)
        yield row


def read_content(content: bytes, strict: bool = True) -> Iterator[tuple]:
    return read_stream(io.BytesIO(content), strict)


# DataFrames


def revisits(pages: DataFrame, least: int = REVISIT_LEAST, salts: int = SALTS) -> DataFrame:
    """_page, _digest, refers_to of the rows that revisit: a payload of `least` bytes or more of which a smaller
    page_id has an equal one. Groups of equal payloads are merged and looked up by salted digests."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.where((F.octet_length(html) >= least) & F.col("page_id").isNotNull())
    rows = rows.select(F.col("page_id").cast("long").alias("_page"), F.unhex(F.sha2(html, 256)).alias("_digest"))
    rows = rows.withColumn("salt", salt_of("_page", salts=salts))
    cells = rows.groupBy("_digest", "salt").agg(F.min("_page").alias("low"), F.max("_page").alias("high"))
    groups = cells.groupBy("_digest").agg(F.min("low").alias("refers_to"), F.max("high").alias("high"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))
    found = groups.where("high > refers_to").select("_digest", "refers_to", salts_in(F.col("salts"), salts).alias("salt"))
    return rows.join(found, ["_digest", "salt"]).where("_page > refers_to").select("_page", "_digest", "refers_to").distinct()


def pack(batches: Iterable[pa.RecordBatch], prefix: str, archive_bytes: int, archive_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows of record arguments to archives. Holds one archive's records, and one record beyond archive_bytes."""

    def made(held: list[bytes]) -> pa.RecordBatch:
        content = archive(held)
        name = f"{prefix}{hashlib.sha256(content).hexdigest()[:32]}"
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["archive_id", "content"])

    held: list[bytes] = []
    size = 0
    for batch in batches:
        for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(record(page, url, (html or "").encode(), refers))
            size += len(held[-1])
            if size >= archive_bytes or len(held) >= archive_rows:
                yield made(held)
                held, size = [], 0
    if held:
        yield made(held)


def write(pages: DataFrame, least: int = REVISIT_LEAST, archive_bytes: int = ARCHIVE_BYTES, archive_rows: int = ARCHIVE_ROWS) -> DataFrame:
    """Archives (archive_id, content) of pages (page_id, url, html), to be stored."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    digest = F.unhex(F.sha2(F.coalesce(F.col("html"), F.lit("")), 256))
    back = revisits(own, least)
    rows = own.join(back, (F.col("page_id") == F.col("_page")) & (digest == F.col("_digest")), "left").select("page_id", "url", "html", "refers_to")
    return rows.mapInArrow(lambda it: pack(it, "a", archive_bytes, archive_rows), ARCHIVES)


def record_batches(found: Iterator[tuple], payloads: bool, rows: int) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in RECORDS.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]] for f in RECORDS.split(", ")]
    while held := list(islice(found, rows)):
        columns = dict(zip(names, zip(*held, strict=True), strict=True))
        if not payloads:
            columns["payload"] = [None] * len(held)
        yield pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in zip(names, types, strict=True)], names=names)


def read(archives: DataFrame, payloads: bool = True, rows: int = 64, strict: bool = False) -> DataFrame:
    """RECORDS of archives (content)."""

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from record_batches(read_content(content.as_py(), strict), payloads, rows)

    return archives.select("content").mapInArrow(records, RECORDS)


def read_files(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """RECORDS of .warc.zst files, in any store that Spark reads; a task holds a whole compressed file."""
    return read(spark.read.format("binaryFile").load(path), strict=strict)


def stream_files(spark: SparkSession, path: str, payloads: bool = True, rows: int = 64, strict: bool = False) -> DataFrame:
    """RECORDS of .warc.zst files, in stores that pyarrow reaches; a task holds one record."""

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(uri)
                with store.open_input_stream(at, compression=None) as f:
                    yield from record_batches(read_stream(f, strict), payloads, rows)

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(records, RECORDS)


def export(archives: DataFrame, uri: str) -> DataFrame:
    """Writes .warc.zst files to a folder that all executors reach; returns their names and sizes. A file
    appears under its final name when it is whole, so a retried task does no harm."""

    def save(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root)
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(content)
                store.move(part, f"{root}/{name}.warc.zst")
                yield pa.RecordBatch.from_arrays([pa.array([f"{name}.warc.zst"]), pa.array([len(content)], pa.int64())], names=["name", "bytes"])

    return archives.select("archive_id", "content").mapInArrow(save, "name string, bytes long")


def base_columns(records: DataFrame) -> list[Column]:
    return [F.col(c) for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stored(write(table(spark, sf_dir, "pages")), "warc")
    records = read(archives, payloads=False, strict=True)
    return records.select(*base_columns(records))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
     q AS (SELECT page_id, octet_length(b) AS n, d, min(page_id) OVER (PARTITION BY b) AS low FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id > low THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > low THEN low END AS refers_to
FROM q
"""
