"""WARC archives in Zstandard: one frame per record, the dictionary in a leading frame.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each
record is one frame compressed with it and stating its content size. Frames are written
through Spark's text writer, whose line separator is an empty skippable frame: any file
system that Spark can write to takes the archives, tasks commit as Spark's files do, and
every Zstandard reader steps over the separators.

Reading validates everything it can: frame structure, version line, mandatory headers,
Content-Length against the block, the HTTP block's own length, and the SHA-1 of payloads.
A damaged archive raises with the file's path instead of losing records.

Defined results: a null payload is empty; a null url is written as `urn:null`; control
characters and blanks in urls are percent-encoded. Records with a null id are always
responses and never the one that others refer to; equal ids with equal payloads are all
responses if that id is the smallest. Repeated rows give a record each. An empty table gives
no records. One archive is one task's output, so record sizes are only bounded by memory
for a single payload and 2 GB for a file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values of the formats
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
SEPARATOR = "P*M\x18\0\0\0\0"  # magic 0x184D2A50 and length 0, little-endian
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:tidemill:page:"


@dataclass(frozen=True)
class WarcSettings:
    least_revisit_bytes: int = 0  # equal payloads below this size are stored again
    date: str = "2024-01-01T00:00:00Z"
    level: int = 3
    dictionary_bytes: int = 64 << 10
    sample_rows: int = 400  # bound on the payloads that the dictionary is trained on
    sample_payload: int = 64 << 10  # payloads above this size are not used for training
    verify: bool = True


def train_dictionary(pages: DataFrame, html: str, settings: WarcSettings) -> bytes:
    """A dictionary from a bounded sample of payloads; empty if there is too little to learn."""
    rows = pages.select(F.col(html).alias("html")).filter(
        F.octet_length("html").between(1, settings.sample_payload)
    )
    sample = rows.orderBy(F.xxhash64("html"), "html").limit(settings.sample_rows).collect()
    payloads = [r["html"].encode() for r in sample]
    try:
        return zstandard.train_dictionary(settings.dictionary_bytes, payloads).as_bytes()
    except zstandard.ZstdError:
        return b""


def _field(value: str | None) -> str:
    if value is None:
        return "urn:null"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record: a full HTTP response, or the revisit of an earlier one."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    lines = [
        VERSION.decode(),
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{RECORD_URN}{'null' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_field(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{RECORD_URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def assign_revisits(pages: DataFrame, page_id: str, url: str, html: str, settings: WarcSettings) -> DataFrame:
    """page_id, url, html, digest, refers_to: which record holds a payload, which refer to it.

    Payload groups are reduced map-side to (smallest id, count); only groups of two and more
    are joined back, and adaptive execution splits a group that holds many rows.
    """
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")
    ).withColumn("digest", F.unhex(F.sha1(F.encode("html", "utf-8"))))
    long_enough = F.octet_length("html") >= settings.least_revisit_bytes
    groups = rows.filter(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = groups.filter("n > 1").drop("n")
    later = long_enough & (F.col("page_id") > F.col("first"))
    return rows.join(groups, "digest", "left").withColumn("refers_to", F.when(later, F.col("first"))).drop("first")


def write_archives(pages: DataFrame, page_id: str, url: str, html: str, path: str, settings: WarcSettings | None = None) -> None:
    """Write a record for every row below `path`, one archive per task."""
    s = settings or WarcSettings()
    dictionary = pages.sparkSession.sparkContext.broadcast(train_dictionary(pages, html, s))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, started = dictionary.value, False
        trained = zstandard.ZstdCompressionDict(words) if words else None
        compressor = zstandard.ZstdCompressor(level=s.level, dict_data=trained, write_content_size=True, write_checksum=True)
        for batch in batches:
            out, size = [], 0
            if batch.num_rows and not started:
                started = True
                out.append(struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words)
            for page, link, body, digest, refers in zip(
                batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html"),
                batch.column("digest").to_pylist(), batch.column("refers_to").to_pylist(),
            ):
                record = record_bytes(page, link, body.as_py().encode(), _base32(digest), refers, s.date)
                out.append(compressor.compress(record))
                size += len(out[-1])
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    rows = assign_revisits(pages, page_id, url, html, s).mapInArrow(frames, "frame binary")
    rows.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def frame_length(data: memoryview, at: int) -> int:
    """Bytes of the Zstandard frame at `at`, from its header and block headers alone."""
    try:
        flags = data[at + 4]
        single, checksum = flags >> 5 & 1, flags >> 2 & 1
        content = (single, 2, 4, 8)[flags >> 6]
        end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + content
        while True:
            head = data[end] | data[end + 1] << 8 | data[end + 2] << 16
            end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
            if head & 1:
                break
    except IndexError:
        raise ValueError(f"the frame at byte {at} is cut off") from None
    end += 4 * checksum
    if end > len(data):
        raise ValueError(f"the frame at byte {at} is cut off")
    return end - at


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of one archive, decoded frame by frame."""
    view, at, reader, first = memoryview(data), 0, None, True
    while at < len(view):
        if at + 8 > len(view):
            raise ValueError(f"stray bytes at {at}")
        magic, length = struct.unpack_from("<II", view, at)
        if magic in SKIPPABLE:
            if at + 8 + length > len(view):
                raise ValueError(f"the skippable frame at byte {at} is cut off")
            if magic == DICTIONARY_MAGIC:
                if not first:
                    raise ValueError(f"a dictionary after the first frame, at byte {at}")
                words = bytes(view[at + 8 : at + 8 + length])
                if words[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may itself be compressed
                    words = zstandard.ZstdDecompressor().decompress(words)
                trained = zstandard.ZstdCompressionDict(words) if words else None
                reader = zstandard.ZstdDecompressor(dict_data=trained)
            at += 8 + length
        elif magic == FRAME_MAGIC:
            length = frame_length(view, at)
            reader = reader or zstandard.ZstdDecompressor()
            yield reader.decompress(view[at : at + length])
            at += length
        else:
            raise ValueError(f"no frame begins at byte {at}")
        first = False


@dataclass(frozen=True)
class Record:
    page_id: int | None
    url: str
    payload: bytes | None
    payload_bytes: int
    digest: str
    kind: str
    refers_to: int | None


def _identity(value: str) -> int | None:
    match = re.fullmatch(f"<{RECORD_URN}(null|-?[0-9]+)>", value)
    if not match:
        raise ValueError(f"record id {value}")
    return None if match[1] == "null" else int(match[1])


def _headers(block: bytes) -> tuple[bytes, dict[str, str]]:
    first, *lines = block.split(b"\r\n")
    pairs = (x.decode("utf-8").partition(":") for x in lines)
    return first, {name.strip().lower(): value.strip() for name, _, value in pairs}


def parse_record(data: bytes, verify: bool = True) -> Record:
    """One record, its headers, lengths and digest validated."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, headers = _headers(head)
    if version != VERSION or not gap:
        raise ValueError("no WARC version line or header end")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in headers:
            raise ValueError(f"{name} is missing")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {size} does not match a block of {len(rest) - 4}")
    status, gap, body = rest[:size].partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("the HTTP header has no end")
    stated = int(_headers(status)[1]["content-length"])
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "revisit":
        if body or "warc-refers-to" not in headers:
            raise ValueError("a revisit with a payload, or without the record it refers to")
    elif kind != "response" or len(body) != stated:
        raise ValueError(f"a {kind} of {len(body)} bytes states {stated}")
    elif verify and _base32(hashlib.sha1(body).digest()) != digest:
        raise ValueError("the payload's digest differs")
    return Record(
        _identity(headers["warc-record-id"]), headers.get("warc-target-uri", ""), None if kind == "revisit" else body,
        stated, digest, kind, _identity(headers["warc-refers-to"]) if kind == "revisit" else None,
    )


RECORD_SCHEMA = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
)


def read_archives(spark: SparkSession, path: str, payloads: bool = True, settings: WarcSettings | None = None) -> DataFrame:
    """Every record below `path`; `payloads=False` validates them but leaves them out."""
    s = settings or WarcSettings()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            columns = zip(*((r.page_id, r.url, r.payload if payloads else None, r.payload_bytes, r.digest, r.kind, r.refers_to) for r in rows))
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, size = [], 0
                try:
                    for data in records_of(content.as_py()):
                        rows.append(parse_record(data, s.verify))
                        size += 200 + (len(data) if payloads else 0)
                        if size > 1 << 24:
                            yield batch_of(rows)
                            rows, size = [], 0
                except (ValueError, zstandard.ZstdError) as fault:
                    raise ValueError(f"{name}: {fault}") from fault
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return files.load(path).select("path", "content").mapInArrow(decode, RECORD_SCHEMA)
