"""Files of formats that this library reads but doesn't write, made of rows: for queries over the test tables."""

from __future__ import annotations

import io
import struct
import zipfile
from xml.sax.saxutils import escape

NONE = 0xFFFFFFFF


def zip_file(entries: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def docx_file(title: str, creator: str, chapters: list[tuple[str, int, list[str]]], notes: list[str]) -> bytes:
    """chapters: (heading, level, paragraphs); the first paragraph of each is bold and refers to the note of its number."""
    run = lambda text, p="": f"<w:r>{p}<w:t>{escape(text)}</w:t></w:r>"
    body = []
    for i, (heading, level, paragraphs) in enumerate(chapters):
        body.append(f'<w:p><w:pPr><w:pStyle w:val="Heading{level}"/></w:pPr>{run(heading)}</w:p>')
        for k, text in enumerate(paragraphs):
            ref = f'<w:r><w:footnoteReference w:id="{i + 1}"/></w:r>' if not k and i < len(notes) else ""
            body.append(f"<w:p>{run(text, '' if k else '<w:rPr><w:b/></w:rPr>')}{ref}</w:p>")
    footnotes = "".join(f'<w:footnote w:id="{i + 1}"><w:p>{run(n)}</w:p></w:footnote>' for i, n in enumerate(notes))
    parts = {
        "word/document.xml": f'<w:document xmlns:w="w"><w:body>{"".join(body)}</w:body></w:document>', "word/footnotes.xml": f'<w:footnotes xmlns:w="w">{footnotes}</w:footnotes>',
        "docProps/core.xml": f"<c><dc:title>{escape(title)}</dc:title><dc:creator>{escape(creator)}</dc:creator></c>",
    }
    return zip_file([(k, v.encode()) for k, v in parts.items()])


def palmdoc(data: bytes) -> bytes:
    """PalmDOC's compression, with a back reference wherever three bytes repeat."""
    out, i, seen = bytearray(), 0, {}
    while i < len(data):
        key = data[i : i + 3]
        at = seen.get(key, -1) if len(key) == 3 else -1
        step = 3 if 0 <= i - at <= 2047 and at >= 0 and i - at >= 3 else 1
        if step == 3:
            out += struct.pack(">H", 0x8000 | (i - at) << 3)
        elif 9 <= data[i] < 0x80 or data[i] == 0:
            out.append(data[i])
        else:
            out += bytes((1, data[i]))
        for k in range(i, i + step):
            seen[data[k : k + 3]] = k
        i += step
    return bytes(out)


def varint(n: int) -> bytes:
    """Big-endian groups of 7 bits, the last one marked."""
    groups = [n & 0x7F | 0x80]
    while n := n >> 7:
        groups.append(n & 0x7F)
    return bytes(reversed(groups))


def index_records(rows: list[tuple[bytes, bytes]], tags: list[tuple[int, ...]], strings: bytes = b"") -> list[bytes]:
    head = b"INDX" + struct.pack(">IIIIIIIIIII", 56, 0, 0, 0, 0, 1, 65001, 0, 0, 0, 0) + struct.pack(">II", 0, 1 if strings else 0)
    tagx = b"TAGX" + struct.pack(">II", 12 + 4 * len(tags), 1) + b"".join(map(bytes, tags))
    body, at = b"", []
    for name, data in rows:
        at.append(56 + len(body))
        body += bytes([len(name)]) + name + data
    record = b"INDX" + struct.pack(">IIIIII", 56, 0, 0, 0, 56 + len(body), len(rows)) + b"\0" * 28 + body + b"IDXT" + b"".join(struct.pack(">H", x) for x in at)
    return [head.ljust(56, b"\0") + tagx, record, *([strings] if strings else [])]


def kf8_file(title: str, chapters: list[tuple[str, str, int]], image: bytes, asin: str, locale: int, record: int = 4096) -> bytes:
    """A compressed AZW3 of chapters (title, html, depth from 0). Each is a skeleton with a fragment in its body; the contents name
    them all."""
    main, skeletons, fragments, labels, entries = b"", [], [], b"", []
    for i, (name, html, depth) in enumerate(chapters):
        shell, inner = b"<html><body></body></html>", html.encode()
        skeletons.append((b"SKEL%06d" % i, b"\x03" + varint(1) + varint(len(main)) + varint(len(shell))))
        fragments.append((b"%010d" % (len(main) + 12), b"\x01" + varint(0) + varint(len(inner))))
        entries.append((b"%03d" % i, b"\x07" + varint(len(labels)) + varint(depth) + varint(i) + varint(0)))
        labels += varint(len(name.encode())) + name.encode()
        main += shell + inner
    texts = [palmdoc(main[i : i + record]) + b"\x81" for i in range(0, len(main), record)]  # with an empty trailing entry each
    skel, frag = index_records(skeletons, [(1, 1, 1, 0), (6, 2, 2, 0), (0, 0, 0, 1)]), index_records(fragments, [(6, 2, 1, 0), (0, 0, 0, 1)])
    ncx = index_records(entries, [(3, 1, 1, 0), (4, 1, 2, 0), (6, 2, 4, 0), (0, 0, 0, 1)], labels)
    flows = b"FDST" + struct.pack(">IIII", 12, 1, 0, len(main))
    first = 1 + len(texts)
    places = {252: first, 248: first + len(skel), 244: first + len(skel) + len(frag), 192: first + len(skel) + len(frag) + len(ncx)}
    h = bytearray(16 + 264)
    struct.pack_into(">HHIHHHH", h, 0, 2, 0, len(main), len(texts), record, 0, 0)
    h[16:20] = b"MOBI"
    struct.pack_into(">IIII", h, 20, 264, 2, 65001, 0)
    exth_rows = [(113, asin.encode()), (201, struct.pack(">I", 0)), (503, title.encode())]
    body = b"".join(struct.pack(">II", k, len(v) + 8) + v for k, v in exth_rows)
    exth = b"EXTH" + struct.pack(">II", 12 + len(body), len(exth_rows)) + body
    for at, x in {36: 8, 92: locale, 108: places[192] + 1, 128: 0x40, 168: NONE, 240: 2, **places}.items():
        struct.pack_into(">I", h, at, x)
    records = [bytes(h) + exth, *texts, *skel, *frag, *ncx, flows, image]
    out, at = b"t".ljust(60, b"\0") + b"BOOKMOBI" + b"\0" * 8 + struct.pack(">H", len(records)), 78 + 8 * len(records)
    for r in records:
        out += struct.pack(">II", at, 0)
        at += len(r)
    return out + b"".join(records)
