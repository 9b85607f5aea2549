import base64
import hashlib
import io

import pytest
import zstandard

from tidemill.llm import warc
from tidemill.llm.queries import QUERIES


def expected(rows, least=0):
    groups = {}
    for page, html in rows:
        data = (html or "").encode()
        if len(data) >= least:
            groups.setdefault(data, []).append(page)
    out = []
    for page, html in rows:
        data = (html or "").encode()
        ids = [i for i in groups.get(data, []) if i is not None]
        first = min(ids, default=None)
        later = page is not None and len(data) >= least and len(groups[data]) > 1 and page > first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if later else "response", first if later else None))
    return sorted(out, key=str)


def test_round_trip_of_the_pages(spark, sf):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    rows = QUERIES["op4_warc"](spark, sf).select(names).collect()
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert sorted(map(tuple, rows), key=str) == expected([(p["page_id"], p["html"]) for p in pages])


@pytest.mark.parametrize("least", [0, 3])
def test_odd_pages(spark, folder, least):
    rows = [(1, "u", None), (2, None, ""), (3, "a b\r\nX: y", "same"), (4, "u", "same"), (None, "u", "same"), (3, "u", "same"),
            (6, "u", "é\r\n\r\n漢" * 100_000), (7, "u", "ab"), (8, "u", "ab")]
    pages = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, digest int")
    settings = warc.WarcSettings(least_revisit_bytes=least)
    warc.write_archives(pages, "page_id", "url", "html", folder, settings)
    back = warc.read_archives(spark, folder, settings=settings).collect()
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back]
    assert sorted(got, key=str) == expected([(r[0], r[2]) for r in rows], least)
    assert {bytes(r["payload"]) for r in back if r["record_type"] == "response"} == {(r[2] or "").encode() for r in rows}
    assert {r["url"] for r in back} == {"u", "urn:null", "a%20b%0D%0AX:%20y"}


def test_empty_table(spark, folder):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), "page_id", "url", "html", folder)
    assert warc.read_archives(spark, folder).count() == 0


def archive(records, words=b""):
    trained = zstandard.ZstdCompressionDict(words) if words else None
    packer = zstandard.ZstdCompressor(dict_data=trained, write_checksum=True)
    head = (0x184D2A5D).to_bytes(4, "little") + len(words).to_bytes(4, "little") + words
    return head + b"".join(packer.compress(r) for r in records)


def test_any_zstd_reader_takes_the_frames():
    records = [warc.record_bytes(i, "u", b"x" * 300_000 * i, "D", None, "d") for i in range(3)]
    data = archive(records)
    assert list(warc.records_of(data)) == records
    reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)
    assert reader.read() == b"".join(records)


def test_compressed_dictionary():
    samples = [b"some header: value %d\r\n" % i * 20 for i in range(300)]
    words = zstandard.train_dictionary(2000, samples).as_bytes()
    frames = archive(samples[:3], words)[8 + len(words) :]
    packed = zstandard.compress(words)
    head = (0x184D2A5D).to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed
    assert list(warc.records_of(head + frames)) == samples[:3]


@pytest.mark.parametrize("spoil", [lambda d: d[:-3], lambda d: d[:40] + b"?" + d[41:], lambda d: d + b"abc", lambda d: d + b"\0" * 12])
def test_damage_is_noticed(spoil):
    data = archive([warc.record_bytes(1, "u", b"payload" * 9, "D", None, "d")] * 2)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.records_of(spoil(data)))


@pytest.mark.parametrize("old, new", [(b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: 5", b"Content-Length: 6"), (b"sha1:", b"sha1:A"), (b"WARC-Date", b"Date")])
def test_records_are_validated(old, new):
    body = b"hello"
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    record = warc.record_bytes(1, "u", body, digest, None, "2024-01-01T00:00:00Z")
    assert warc.parse_record(record).payload == body
    assert old in record
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(old, new, 1))
