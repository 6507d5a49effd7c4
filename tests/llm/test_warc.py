import hashlib
import io
import os
import struct
import time

import pytest
import zstandard

from quire.llm import warc as m
from quire.llm.common import stored
from tests.llm.util import duck, rows


def test_equals_sql(spark, sf):
    assert rows(m.query(spark, sf)) == duck(m.SQL, sf)


def brute(data):
    low, out = {}, []
    for i, _, h in data:
        p = (h or "").encode()
        if len(p) >= 100 and i is not None:
            low[p] = min(i, low.get(p, i))
    for i, _, h in data:
        p = (h or "").encode()
        r = low.get(p) if i is not None and low.get(p) != i else None
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "response" if r is None else "revisit", r))
    return sorted(out, key=repr)


def test_odd_rows(spark):
    big, huge = "b" * 100, "é<p>" * 300_000
    data = [(5, "u", big), (3, None, big), (9, "x\r\ny", big), (4, "u", "b" * 99), (6, "u", "b" * 99), (7, "u", None), (8, "u", ""), (None, "u", big),
            (3, "again", big), (9, "again", big), (1, "", huge), (2, "", huge), (10, "d", "\r\n\r\nWARC/1.1\r\n" + big), (2**62 + 1, "u", big)]
    pages = spark.createDataFrame([(*r, 7, "x", 1) for r in data], "page_id long, url string, html string, payload_bytes int, refers_to string, salt int")
    archives = stored(m.write(pages), "t")
    got = m.read(archives)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=repr) == brute(data)
    for r in got.collect():
        assert (r.payload is None) == (r.record_type == "revisit")
        assert r.payload is None or hashlib.sha256(r.payload).hexdigest() == r.payload_digest
    assert m.read(stored(m.write(pages.limit(0)), "t")).count() == 0


def test_large_group(spark):
    pages = spark.createDataFrame([(i, "u", "same" * 50) for i in range(2000)], "page_id long, url string, html string")
    got = m.read(stored(m.write(pages), "t"), payloads=False).collect()
    assert sum(r.record_type == "response" for r in got) == 1 and {r.refers_to for r in got} == {None, 0}


def test_files(spark, sf, tmp_path):
    archives = stored(m.write(spark.read.parquet(f"{sf}/pages.parquet"), archive_bytes=20_000), "t")
    m.export(archives, f"file://{tmp_path}/w").collect()
    files = sorted((tmp_path / "w").iterdir())
    assert len(files) > 3 and all(f.name.endswith(".warc.zst") for f in files)
    assert rows(m.read_files(spark, f"{tmp_path}/w")) == rows(m.read(archives)) == rows(m.stream_files(spark, f"{tmp_path}/w"))


def frames(content):
    return m.frames(io.BytesIO(content))


def some(n=40):
    return [m.record(i, f"http://h/{i}", f"<p>page {i} of some pages</p>".encode() * 20, None) for i in range(n)]


def test_dictionary_frame():
    content = m.archive(some())
    magic, size = struct.unpack_from("<II", content)
    assert magic == m.DICT_MAGIC and len(list(frames(content))) == 40
    assert list(frames(content)) == some()
    plain = zstandard.ZstdDecompressor().decompress(content[8 : 8 + size])
    bare = struct.pack("<II", m.DICT_MAGIC, len(plain)) + plain + content[8 + size :]
    assert list(frames(bare)) == some()  # a dictionary may also be stored as it is
    with pytest.raises(m.WarcError):
        list(frames(content[8 + size :]))  # without its dictionary
    assert list(frames(m.archive(some(3)))) == some(3) and list(frames(b"")) == []


@pytest.mark.parametrize("change", [
    lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), lambda r: r.replace(b"WARC-Date", b"X-Date"), lambda r: r[:-1],
    lambda r: r.replace(b"page 1", b"page 2"), lambda r: r.replace(b"Content-Length: ", b"Content-Length: 1", 1),
    lambda r: r.replace(b"WARC-Type: response", b"WARC-Type response"), lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: revisit"),
    lambda r: r.replace(b"Payload-Digest: sha256:", b"Payload-Digest: sha256:0"),
])
def test_broken_records(change):
    good = some()[1]
    assert m.page_of(good)[0] == 1
    with pytest.raises(m.WarcError):
        m.page_of(change(good))


def test_broken_archives():
    content = m.archive(some())
    for broken in (content[:-3], content + b"abc", content + b"garbage!!", content[:100] + b"\0" * 8 + content[108:]):
        with pytest.raises((m.WarcError, zstandard.ZstdError)):
            list(map(m.page_of, frames(broken)))


def other(kind, block, digest=None):
    head = f"WARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{kind}>\r\nWARC-Date: {m.DATE}\r\n" + (f"WARC-Block-Digest: {digest}\r\n" if digest else "")
    return m.VERSION + b"\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def test_other_records_are_read():
    blocks = {"warcinfo": b"software: x\r\n", "request": b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "metadata": b"a: b\r\n", "resource": b"bytes"}
    got = list(m.read_content(m.archive([other(k, b) for k, b in blocks.items()] + [m.record(1, "u", b"page", None)])))
    assert [r[3] for r in got] == [*blocks, "response"] and got[3][-2] == b"bytes" and got[0][-2] == blocks["warcinfo"]
    with pytest.raises(m.WarcError):
        list(m.read_content(m.archive([other("metadata", b"a", m.sha(b"b"))])))


def test_headers_that_repeat():
    twice = [("WARC-Concurrent-To", "<urn:a>"), ("WARC-Concurrent-To", "<urn:b>")]
    raw = lambda more: other("metadata", b"x").replace(b"WARC-Date", b"".join(f"{k}: {v}\r\n".encode() for k, v in more) + b"WARC-Date", 1)
    h, _ = m.parsed(raw(twice))
    assert h["warc-concurrent-to"] == "<urn:a>, <urn:b>"
    with pytest.raises(m.WarcError):
        m.parsed(raw([("WARC-Date", "2020")]))
    http = b"HTTP/1.1 200 OK\r\nSet-Cookie: a\r\nSet-Cookie: b\r\nX-Long: one\r\n two\r\nContent-Length: 2\r\n\r\nhi"
    assert m.page_of(other("response", http))[-2] == b"hi"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 9\r\n\r\n2\r\nhi\r\n0\r\n\r\n"
    assert m.page_of(other("response", chunked))[1] == 12
    dns = other("response", b"20200101 example.org").replace(b"WARC-Date", b"Content-Type: text/dns\r\nWARC-Date", 1)
    assert m.page_of(dns)[-2] == b"20200101 example.org"


def test_bad_records_are_rows(spark):
    good, bad = some(20), other("metadata", b"a", m.sha(b"b"))
    whole = m.archive([*good[:10], bad, *good[10:]])
    archives = spark.createDataFrame([("a", whole), ("b", whole[:-5]), ("c", b"no archive at all")], m.ARCHIVES)
    got = m.read(archives).collect()
    assert len(got) == 21 + 21 + 1
    assert [bool(r.error) for r in got] == [False] * 10 + [True] + [False] * 10 + [False] * 10 + [True] + [False] * 9 + [True] + [True]
    assert all((r.page_id is None) == bool(r.error) for r in got)
    with pytest.raises(Exception, match="digest"):
        m.read(archives.where("archive_id = 'a'"), strict=True).collect()


def test_reading_is_linear():
    spent = []
    for n in (2000, 16000):
        content = m.archive([m.record(i, "u", os.urandom(700), None) for i in range(n)])
        began = time.process_time()
        assert sum(1 for _ in frames(content)) == n
        spent.append(time.process_time() - began)
    assert spent[1] < 20 * max(spent[0], 0.05)
