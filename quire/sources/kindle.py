"""Kindle files: the record container, MOBI (KF7) and AZW3 (KF8)."""

from __future__ import annotations

import codecs
import locale
import re
import struct

from quire.functions.markup import plain_text, rewritten, sanitize, tokens
from quire.model import BookError, chapter, nav_from_levels, new_book, stem, validate, warn

#: Fixed values of the formats.
NONE, HUFF, PALMDOC = 0xFFFFFFFF, 17480, 2
EXTH = {100: "author", 101: "publisher", 103: "description", 104: "isbn", 106: "date", 113: "asin", 503: "title", 524: "language"}
CHINESE, TRADITIONAL = 4, (1, 3)
codecs.register_error("c1", lambda e: (e.object[e.start : e.end].decode("latin-1"), e.end))


def language_of_tag(tag: str | None) -> str | None:
    """A language tag as books carry it: Chinese by script, the common ones without region."""
    low = (tag or "").lower()
    if low.startswith("zh"):
        return "zh-Hant" if re.search("tw|hk|hant|mo", low) else "zh-Hans"
    return low[:2] if low[:2] in ("ja", "ko", "en", "fr", "de", "es") else tag or None


def language_of_locale(code: int, regions: bool) -> str | None:
    """The language of a Windows locale number, whose low byte names it; regions: whether those of Chinese count."""
    if code & 0xFF == CHINESE:
        return "zh-Hant" if regions and code >> 10 & 0xFF in TRADITIONAL else "zh-Hans"
    found = next((v[:2] for k, v in sorted(locale.windows_locale.items()) if k & 0xFF == code & 0xFF and code & 0xFF), None)
    return "no" if found in ("nb", "nn") else found
IMAGES = ((b"\xff\xd8\xff", "image/jpeg", "jpg"), (b"\x89PNG", "image/png", "png"), (b"GIF", "image/gif", "gif"), (b"BM", "image/bmp", "bmp"))


def records(data: bytes) -> list[bytes]:
    if len(data) < 80:
        raise BookError("the file is too short")
    n = struct.unpack_from(">H", data, 76)[0]
    if len(data) < 78 + 8 * n or not n:
        raise BookError("the record list is cut off")
    at = [struct.unpack_from(">I", data, 78 + 8 * i)[0] for i in range(n)] + [len(data)]
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


def unpacked(data: bytes) -> bytes:
    """PalmDOC's LZ77; references before the start give spaces."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if 1 <= c <= 8:
            out += data[i : i + c]
            i += c
        elif c < 0x80:
            out.append(c)
        elif c >= 0xC0:
            out += bytes((0x20, c ^ 0x80))
        elif i < len(data):
            pair = (c << 8 | data[i]) & 0x3FFF
            i += 1
            back, n = pair >> 3, (pair & 7) + 3
            for _ in range(n):
                out.append(out[-back] if 0 < back <= len(out) else 0x20)
    return bytes(out)


def trimmed(record: bytes, flags: int) -> bytes:
    """A text record without its trailing entries: one for each flag bit above the lowest, whose size stands in
    7-bit groups at the end; the lowest bit stands for a part of a character."""
    for _ in range(bin(flags >> 1).count("1")):
        size, shift = 0, 0
        for b in reversed(record[-4:]):
            size |= (b & 0x7F) << shift
            shift += 7
            if b & 0x80:
                break
        record = record[: len(record) - size] if 0 < size <= len(record) else record
    if flags & 1 and record:
        record = record[: -((record[-1] & 3) + 1)]
    return record


class Header:
    """The first record of a book, `base` records into the file."""

    def __init__(self, recs: list[bytes], base: int = 0):
        h = self.data = recs[base]
        self.base = base
        if h[16:20] != b"MOBI":
            raise BookError("no MOBI header")
        self.compression, self.text_length, self.text_records = struct.unpack_from(">H2xIH", h, 0)
        self.encryption = struct.unpack_from(">H", h, 12)[0]
        self.length = self.u32(20)
        self.encoding = "utf-8" if self.u32(28) == 65001 else "cp1252"
        self.version = self.u32(36)
        self.first_image = self.u32(108)
        self.flags = self.u32(240) & 0xFFFF if self.length >= 228 and len(h) >= 244 else 0
        at, n = self.u32(84), self.u32(88)
        self.title = self.text(h[at : at + n]) if at + n <= len(h) else ""
        self.exth = self.extended()
        if self.encryption or (len(h) >= 184 and self.u32(168) not in (0, NONE) and self.u32(172) not in (0, NONE)):
            raise BookError("the book is protected")
        if self.compression not in (1, PALMDOC):
            raise BookError("this compression isn't supported" if self.compression != HUFF else "Huffman compression isn't supported")

    def u32(self, at: int, default: int = NONE) -> int:
        return struct.unpack_from(">I", self.data, at)[0] if at + 4 <= len(self.data) else default

    def text(self, raw: bytes) -> str:
        return raw.decode(self.encoding, "replace") if self.encoding == "utf-8" else raw.decode("cp1252", "c1")

    def extended(self) -> list[tuple[int, bytes]]:
        at = 16 + self.length
        out: list[tuple[int, bytes]] = []
        if not self.u32(128, 0) & 0x40 or self.data[at : at + 4] != b"EXTH":
            return out
        count = self.u32(at + 8, 0)
        at += 12
        for _ in range(count):
            if at + 8 > len(self.data):
                break
            kind, size = struct.unpack_from(">II", self.data, at)
            if size < 8:
                break
            out.append((kind, self.data[at + 8 : at + size]))
            at += size
        return out

    def number(self, kind: int) -> int | None:
        return next((int.from_bytes(v, "big") for k, v in self.exth if k == kind and len(v) <= 4), None)

    def content(self, recs: list[bytes]) -> bytes:
        parts = [trimmed(r, self.flags) for r in recs[self.base + 1 : self.base + 1 + self.text_records]]
        return b"".join(unpacked(p) if self.compression == PALMDOC else p for p in parts)

    def book(self, name: str, data: bytes) -> dict:
        meta: dict[str, str] = {}
        for kind, raw in self.exth:
            if (key := EXTH.get(kind)) and (value := self.text(raw).strip("\0 ")):
                meta[key] = f"{meta[key]}、{value}" if key == "author" and key in meta else meta.get(key, value)
        if d := meta.get("date"):
            m = re.match(r"\d{4}-\d{2}-\d{2}", d)
            meta["date"] = m[0] if m else f"{d}-01-01" if re.fullmatch(r"\d{4}", d) else ""
        isbn, asin = meta.pop("isbn", None), meta.pop("asin", None)
        kf8 = self.version >= 8
        if kf8:
            meta["language"] = language_of_locale(self.u32(92, 0), True)
            meta["identifier"] = f"urn:mobi:asin:{asin}" if asin else None
        else:
            meta["language"] = language_of_tag(meta.get("language")) or language_of_locale(self.u32(92, 0), False)
            meta["identifier"] = f"urn:isbn:{isbn}" if isbn else None
        return new_book(name, data, **({"title": self.title or stem(name)} | meta))


def image_kind(data: bytes) -> tuple[str, str] | None:
    return next(((mime, ext) for magic, mime, ext in IMAGES if data.startswith(magic)), None)


class Images:
    """Image records by their number from 1, kept when they are used."""

    def __init__(self, recs: list[bytes], first: int, book: dict):
        self.recs, self.first, self.book = recs, first, book
        self.used: dict[int, dict] = {}

    def take(self, number: int) -> dict | None:
        at = self.first + number - 1
        if number < 1 or not 0 <= at < len(self.recs) or not (kind := image_kind(self.recs[at])):
            return None
        if number not in self.used:
            k = len(self.used) + 1
            self.used[number] = {"id": f"img{k:03}", "href": f"images/img{k:03}.{kind[1]}", "mime": kind[0], "data": self.recs[at]}
            self.book["resources"].append(self.used[number])
        return self.used[number]


def read_mobi(data: bytes, name: str) -> dict:
    if data[60:68] != b"BOOKMOBI":
        raise BookError("no MOBI file")
    recs = records(data)
    head = Header(recs)
    book = head.book(name, data)
    raw = head.content(recs)[: head.text_length]
    images = Images(recs, head.first_image, book)
    # anchors for links by byte position, put in before bytes become text
    places = sorted({int(x) for x in re.findall(rb"filepos=[\"']?0*(\d+)", raw, re.I)}, reverse=True)
    for at in places:
        if at <= len(raw):
            cut = raw.rfind(b"<", 0, at)  # not within a tag
            put = cut if cut > raw.rfind(b">", 0, at) else at
            raw = raw[:put] + b'<a id="filepos%d"></a>' % at + raw[put:]
    html = head.text(raw)
    html = re.sub(r"(?is)^.*?<body[^>]*>|</body>.*$", "", html)
    html = re.sub(r"(?i)filepos=[\"']?0*(\d+)[\"']?", r'href="#filepos\1"', html)
    html = re.sub(r"(?i)<a\s+name=", "<a id=", html)

    def change(tag: str, attrs: list[tuple[str, str]]):
        a = dict(attrs)
        if tag != "img":
            return attrs
        r = images.take(int(a["recindex"])) if a.get("recindex", "").isdigit() else None
        return [("src", r["href"]), ("alt", a.get("alt", ""))] if r else ""

    parts = re.split(r"(?i)<mbp:pagebreak[^>]*>(?:\s*</mbp:pagebreak>)?", html)
    if len(parts) == 1:
        parts = re.split(r"(?i)(?=<h[1-3][\s>])", html)
    for part in parts:
        clean = sanitize(rewritten(part, change))
        m = re.search(r"(?is)<h([1-6])(?:\s[^>]*)?>(.*?)</h\1\s*>", clean)
        title = plain_text(m[2]) if m else None
        body = clean[: m.start()] + clean[m.end() :] if m else clean
        if title or plain_text(body) or "<img" in body:
            chapter(book, title or None, body, min(3, int(m[1])) if m else 1)
    if not book["chapters"]:
        chapter(book, None, "")
        warn(book, "mobi.no-chapters")
    nav_from_levels(book)
    for n in book["nav"]:
        n |= {"parent": None, "level": 1}
    if len(book["chapters"]) > 1:
        warn(book, "mobi.flat-nav")
    known = {v for c in book["chapters"] for t in tokens(c["html"]) if t[0] == "open" for k, v in t[2] if k == "id"}
    if any(f"filepos{x}" not in known for x in places):
        warn(book, "mobi.filepos-unresolved")
    cover = head.number(201)
    if cover is not None and (r := images.take(cover + 1)):
        book["cover"] = r["id"]
    if problems := validate(book):
        raise BookError("; ".join(problems[:5]))
    return book


# KF8


def forward(data: bytes, at: int) -> tuple[int, int]:
    """A number in 7-bit groups, the last with its high bit set; and where it ends."""
    value = 0
    while at < len(data):
        b = data[at]
        at += 1
        value = value << 7 | (b & 0x7F)
        if b & 0x80:
            break
    return value, at


def index_rows(recs: list[bytes], at: int) -> tuple[list[tuple[bytes, dict[int, list[int]]]], dict[int, bytes]]:
    """Rows (name, values by tag) of an index that starts at a record, and its strings by offset."""
    head = recs[at]
    if head[:4] != b"INDX":
        raise BookError("no index where one should be")
    u = lambda r, i: struct.unpack_from(">I", r, i)[0]
    length, count, strings = u(head, 4), u(head, 24), u(head, 52)
    if head[length : length + 4] != b"TAGX":
        raise BookError("an index without tags")
    size, controls = u(head, length + 4), u(head, length + 8)
    tags = [tuple(head[length + i : length + i + 4]) for i in range(12, size, 4)]
    rows = []
    for r in recs[at + 1 : at + 1 + count]:
        start, n = u(r, 20), u(r, 24)
        offsets = [struct.unpack_from(">H", r, start + 4 + 2 * i)[0] for i in range(n)] + [start]
        for a, b in zip(offsets, offsets[1:], strict=False):
            k = r[a]
            rows.append((r[a + 1 : a + 1 + k], entry(r[a + 1 + k : b], tags, controls)))
    known = {}
    for j in range(strings):
        r, i = recs[at + 1 + count + j], 0
        while i < len(r):
            n, end = forward(r, i)
            if not n:
                break
            known[j * 0x10000 + i] = r[end : end + n]
            i = end + n
    return rows, known


def entry(data: bytes, tags: list[tuple[int, ...]], controls: int) -> dict[int, list[int]]:
    at, byte, found = controls, 0, []
    for tag, per, mask, end in tags:
        if end == 1:
            byte += 1
            continue
        value = data[byte] & mask if byte < len(data) else 0
        if not value:
            continue
        if value == mask and bin(mask).count("1") > 1:
            size, at = forward(data, at)
            found.append((tag, per, None, size))
        else:
            found.append((tag, per, value >> ((mask & -mask).bit_length() - 1), None))
    out: dict[int, list[int]] = {}
    for tag, per, count, size in found:
        values, end = [], at + (size or 0)
        while (len(values) < count * per) if count is not None else at < end:
            if at >= len(data):
                break
            v, at = forward(data, at)
            values.append(v)
        out[tag] = values
    return out


def read_azw3(data: bytes, name: str) -> dict:
    if data[64:68] != b"MOBI":
        raise BookError("no Kindle file")
    recs = records(data)
    head, combined = Header(recs), False
    if head.version < 8:
        boundary = head.number(121)
        if boundary is None or boundary in (0, NONE) or boundary >= len(recs):
            raise BookError("no KF8 content")
        head, combined = Header(recs, boundary), True
        if head.version < 8:
            raise BookError("no KF8 content")
    base = head.base
    book = head.book(name, data)
    if combined:
        warn(book, "azw3.combo")
    raw = head.content(recs)
    flows = [(0, len(raw))]
    fdst = head.u32(192)
    if fdst != NONE and base + fdst < len(recs) and (r := recs[base + fdst])[:4] == b"FDST":
        n = struct.unpack_from(">I", r, 8)[0]
        flows = [struct.unpack_from(">II", r, 12 + 8 * i) for i in range(n)]
    main = raw[flows[0][0] : flows[0][1]]
    skeletons, _ = index_rows(recs, base + head.u32(252)) if head.u32(252) != NONE else ([], {})
    fragments, _ = index_rows(recs, base + head.u32(248)) if head.u32(248) != NONE else ([], {})
    parts: list[tuple[int, int, bytes]] = []  # first and last position, content
    taken = 0
    for _, tags in skeletons:
        count, (start, size) = tags.get(1, [0])[0], tags[6][:2]
        body, at, first = bytearray(main[start : start + size]), start + size, start
        for label, ftags in fragments[taken : taken + count]:
            own = ftags[6][1]
            insert = int(label) - first
            body[insert:insert] = main[at : at + own]
            at += own
        taken += count
        parts.append((start, at, bytes(body)))
    if not parts:
        parts = [(0, len(main), main)]
    images = Images(recs, base + head.first_image if combined else head.first_image, book)
    ids = [f"c{i}" for i in range(1, len(parts) + 1)]

    def part_of(position: int) -> int | None:
        return next((i for i, (a, b, _) in enumerate(parts) if a <= position < b), None)

    def change(tag: str, attrs: list[tuple[str, str]]):
        out = []
        for k, v in attrs:
            if k == "aid":
                out.append(("id", f"aid-{v}"))
            elif tag == "img" and k == "src":
                m = re.match(r"kindle:embed:([0-9A-V]+)", v, re.I)
                r = images.take(int(m[1], 32)) if m else None
                if r is None:
                    warn(book, "azw3.image-unresolved")
                    return ""
                out.append(("src", r["href"]))
            elif k == "href" and (m := re.match(r"kindle:pos:fid:([0-9A-V]+):off:([0-9A-V]+)", v, re.I)):
                fid = int(m[1], 32)
                to = part_of(int(fragments[fid][0]) + int(m[2], 32)) if fid < len(fragments) else None
                if to is None:
                    return None
                out.append(("href", f"#{ids[to]}"))
            else:
                out.append((k, v))
        return out

    for _, _, body in parts:
        html = head.text(body)
        m = re.search(r"(?is)<body[^>]*>(.*)</body\s*>", html)
        html = sanitize(rewritten(m[1] if m else html, change))
        h = re.search(r"(?is)<h[1-6](?:\s[^>]*)?>(.*?)</h[1-6]\s*>", html)
        chapter(book, (plain_text(h[1]) or None) if h else None, html)
    ncx = head.u32(244)
    if ncx != NONE and base + ncx < len(recs) and recs[base + ncx][:4] == b"INDX":
        rows, strings = index_rows(recs, base + ncx)
        above: list[dict] = []
        for _, tags in rows:
            title = head.text(strings.get(tags.get(3, [-1])[0], b""))
            fid, off = (tags.get(6) or [0, 0])[:2]
            to = part_of(int(fragments[fid][0]) + off) if fid < len(fragments) else 0
            level = min(3, tags.get(4, [0])[0] + 1)
            while above and above[-1]["level"] >= level:
                above.pop()
            n = {"id": f"n{len(book['nav']) + 1}", "parent": above[-1]["id"] if above else None, "title": title, "target": ids[to or 0], "anchor": None, "level": level}
            book["nav"].append(n)
            above.append(n)
    if not book["nav"]:
        warn(book, "azw3.no-nav")
        nav_from_levels(book)
    cover = head.number(201)
    if cover is not None and (r := images.take(cover + 1)):
        book["cover"] = r["id"]
    if problems := validate(book):
        raise BookError("; ".join(problems[:5]))
    return book


def read_azw(data: bytes, name: str) -> dict:
    """KF8 if the file holds it, else KF7."""
    try:
        return read_azw3(data, name)
    except (BookError, struct.error, IndexError, KeyError, ValueError) as first:
        try:
            return read_mobi(data, name)
        except (BookError, struct.error, IndexError, KeyError, ValueError) as second:
            raise BookError(f"neither KF8 ({first}) nor KF7 ({second})") from second
