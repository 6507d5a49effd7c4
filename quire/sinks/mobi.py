"""MOBI (KF7), uncompressed: record container, header, metadata, text, images."""

from __future__ import annotations

import re
import struct

from quire.functions.markup import escape_text, rewritten
from quire.sinks.epub import heading_text, without_readings

#: Fixed values of the format.
RECORD, HEADER, PALM_EPOCH, UTF8, NONE = 4096, 232, 2082844800, 65001, 0xFFFFFFFF
#: Windows locale numbers by the start of a language tag, longer ones first.
LOCALES = {
    "zh-hans": 0x0804, "zh-cn": 0x0804, "zh-hant": 0x0404, "zh-tw": 0x0404, "zh": 0x0004, "ja": 0x0411, "ko": 0x0412,
    "en": 0x0409, "fr": 0x040C, "de": 0x0407, "es": 0x040A,
}


def locale_number(language: str | None) -> int:
    return next((n for tag, n in LOCALES.items() if (language or "").lower().startswith(tag)), 0)


def unique_id(text: str) -> int:
    """FNV-1a over UTF-16 units."""
    h = 0x811C9DC5
    for (unit,) in struct.iter_unpack("<H", text.encode("utf-16-le", "surrogatepass")):
        h = (h ^ unit) * 0x01000193 & 0xFFFFFFFF
    return h


def used_images(book: dict) -> list[dict]:
    """The cover, then images in the order of their first use."""
    by = {r["href"]: r for r in book["resources"] if r["mime"].startswith("image/")}
    out = [r for r in by.values() if r["id"] == book["cover"]]
    for part in [*book["chapters"], *book["notes"]]:
        for src in re.findall(r'<img\s[^>]*?src="([^"]*)"', part["html"]):
            if src in by and by[src] not in out:
                out.append(by[src])
    return out


def html_of(book: dict, number: dict[str, int]) -> str:
    def change(tag: str, attrs: list[tuple[str, str]]):
        a = dict(attrs)
        if tag == "img":
            return [("recindex", f"{number[a['src']]:05}"), ("alt", a.get("alt", ""))] if a.get("src") in number else ""
        return [(k, " ".join(x for x in v.split() if x != "noteref") if k == "class" else v) for k, v in attrs if k != "class" or v.split() != ["noteref"]]

    out = []
    for c in book["chapters"]:
        html = rewritten(without_readings(c["html"]), change)
        if c["title"] and heading_text(c["html"]) != c["title"].strip():
            html = f"<h{c['level']}>{escape_text(c['title'])}</h{c['level']}>{html}"
        out.append(f'<a id="{c["id"]}"></a>{html}')
    notes = "".join(f'<div id="{n["id"]}">{rewritten(without_readings(n["html"]), change)}</div>' for n in book["notes"])
    return f"<html><head><guide></guide></head><body>{'<mbp:pagebreak/>'.join(out)}{notes}</body></html>"


def extended(book: dict, has_cover: bool) -> bytes:
    meta = book["meta"]
    rows = [(k, meta[m].encode()) for k, m in ((100, "author"), (101, "publisher"), (103, "description"), (106, "date"), (503, "title"), (524, "language")) if meta[m]]
    if has_cover:
        rows += [(201, struct.pack(">I", 0)), (202, struct.pack(">I", 0))]
    body = b"".join(struct.pack(">II", k, len(v) + 8) + v for k, v in sorted(rows))
    out = b"EXTH" + struct.pack(">II", 12 + len(body), len(rows)) + body
    return out + b"\0" * (-len(out) % 4)


def write(book: dict, seconds: int = 0) -> bytes:
    """seconds: the file's date, since 1970."""
    images = used_images(book)
    text = html_of(book, {r["href"]: i for i, r in enumerate(images, 1)}).encode()
    texts = [text[i : i + RECORD] for i in range(0, len(text), RECORD)] or [b""]
    title = book["meta"]["title"].encode()
    exth = extended(book, bool(book["cover"] and images and images[0]["id"] == book["cover"]))
    first_image = 1 + len(texts)
    h = bytearray(16 + HEADER)
    struct.pack_into(">HHIHHHH", h, 0, 1, 0, len(text), len(texts), RECORD, 0, 0)
    h[16:20] = b"MOBI"
    struct.pack_into(">IIIII", h, 20, HEADER, 2, UTF8, unique_id(book["meta"]["identifier"]), 6)
    for at in range(40, 80, 4):
        struct.pack_into(">I", h, at, NONE)
    struct.pack_into(">III", h, 80, first_image, 16 + HEADER + len(exth), len(title))
    struct.pack_into(">IIII", h, 92, locale_number(book["meta"]["language"]), 0, 0, 6)
    struct.pack_into(">I", h, 108, first_image if images else NONE)
    struct.pack_into(">I", h, 128, 0x40)
    struct.pack_into(">IIII", h, 168, NONE, NONE, 0, 0)
    struct.pack_into(">I", h, 240, 0)
    struct.pack_into(">I", h, 244, NONE)
    head = bytes(h) + exth + title
    head += b"\0" * (-len(head) % 4 + 4)
    recs = [head, *texts, *(r["data"] for r in images), b"\xe9\x8e\r\n"]
    name = re.sub(rb"[^A-Za-z0-9_-]", b"_", title)[:31].ljust(32, b"\0")
    at = 78 + 8 * len(recs) + 2
    out = name + struct.pack(">HHIIIIII", 0, 0, seconds + PALM_EPOCH, seconds + PALM_EPOCH, 0, 0, 0, 0) + b"BOOKMOBI" + struct.pack(">IIH", 2 * len(recs), 0, len(recs))
    for i, r in enumerate(recs):
        out += struct.pack(">II", at, 2 * i)
        at += len(r)
    return out + b"\0\0" + b"".join(recs)
