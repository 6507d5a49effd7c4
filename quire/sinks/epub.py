"""EPUB 3 with an NCX, and the same with sentence spans (KEPUB). The date of the package is an argument, so that a
repeated job writes the same bytes."""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from urllib.parse import quote

from quire.functions import text as T
from quire.functions.markup import JS_SPACE, decode_entities, escape_attribute, escape_text, is_external, rewritten
from quire.schema import VERTICAL

EPOCH = (1980, 1, 1, 0, 0, 0)
MODIFIED = "2020-01-01T00:00:00Z"
RESERVED = ("content.opf", "nav.xhtml", "toc.ncx", "style.css", "mimetype")
CSS = "body{line-height:1.7;margin:1em}p{margin:0;text-indent:2em}img{max-width:100%}aside{font-size:.9em}body.vertical{writing-mode:vertical-rl}"
XHTML = '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="{lang}" xml:lang="{lang}">\n<head><title>{title}</title><link rel="stylesheet" type="text/css" href="style.css"/></head>\n<body{cls}>\n{body}\n</body>\n</html>\n'


def file_bases(chapters: list[dict]) -> list[str]:
    """Distinct file names, compared without case."""
    out, taken = [], {r.rpartition(".")[0] for r in RESERVED}
    for i, c in enumerate(chapters, 1):
        base = re.sub(r"\s+", "-", re.sub(r'[\\/:*?"<>|#%&{}\x00-\x1f]', "", c["title"] or "")).strip("-.")[:60] or f"chapter-{i:04}"
        name, k = base, 2
        while name.lower() in taken:
            name, k = f"{base}-{k}", k + 1
        taken.add(name.lower())
        out.append(f"{name}.xhtml")
    return out


def xml_id(raw: str, taken: dict[str, str]) -> str:
    """An id that XML allows, the same for the same raw one, distinct from others'."""
    if raw not in taken:
        own = re.sub(r"[^\w.-]", "-", unicodedata.normalize("NFC", raw)) or "id"
        own = own if re.match(r"[^\W\d]", own) else f"id-{own}"
        name, k = own, 2
        while name in taken.values():
            name, k = f"{own}-{k}", k + 1
        taken[raw] = name
    return taken[raw]


def without_readings(html: str) -> str:
    return re.sub(r"</?ruby(?:\s[^>]*)?>", "", re.sub(r"<(rt|rp)>.*?</\1>", "", html, flags=re.S | re.I), flags=re.I)


def heading_text(html: str) -> str | None:
    m = re.search(r"<h[1-6](?:\s[^>]*)?>(.*?)</h[1-6]\s*>", without_readings(html), re.S | re.I)
    return decode_entities(re.sub(r"<[^>]*>", "", m[1])).strip(JS_SPACE) if m else None


def note_chapter(book: dict) -> dict[str, int]:
    """Of each note the first chapter that refers to it, else the last."""
    out = {n["id"]: len(book["chapters"]) - 1 for n in book["notes"]}
    for i in range(len(book["chapters"]) - 1, -1, -1):
        for ref in re.findall(r'href="#([^"]*)"', book["chapters"][i]["html"]):
            if ref in out:
                out[ref] = i
    return out


def children(book: dict, parent: str | None) -> list[dict]:
    return [n for n in book["nav"] if n["parent"] == parent]


def documents(book: dict) -> tuple[list[tuple[str, str]], dict[str, str]]:
    """(file, xhtml) of each chapter; and the place of each chapter id."""
    files = file_bases(book["chapters"])
    place = {c["id"]: f for c, f in zip(book["chapters"], files, strict=True)}
    ids: dict[str, str] = {}
    anchor_in: dict[str, str] = {}
    for c, f in zip(book["chapters"], files, strict=True):
        for raw in re.findall(r'\sid="([^"]*)"', c["html"]):
            anchor_in.setdefault(raw, f)
    where = note_chapter(book)
    notes = {n["id"]: n for n in book["notes"]}
    lang, vertical = book["meta"]["language"], book["meta"]["writing_mode"] == VERTICAL
    out = []
    for i, (c, f) in enumerate(zip(book["chapters"], files, strict=True)):

        def change(tag: str, attrs: list[tuple[str, str]], f: str = f):
            got = []
            for k, v in attrs:
                if k == "id":
                    v = xml_id(v, ids)
                elif k == "src" and not is_external(v):
                    v = quote(v)
                elif k == "href" and v.startswith("#"):
                    raw = v[1:]
                    if raw in notes:
                        got.append(("epub:type", "noteref"))
                        home = files[where[raw]]
                    elif raw in place:
                        got.append(("href", quote(place[raw])))
                        continue
                    else:
                        home = anchor_in.get(raw, f)
                    v = f"{'' if home == f else quote(home)}#{xml_id(raw, ids)}"
                got.append((k, v))
            return got

        body = rewritten(c["html"], change)
        if c["title"] and heading_text(c["html"]) != c["title"].strip(JS_SPACE):
            body = f"<h{c['level']}>{escape_text(c['title'])}</h{c['level']}>\n{body}"
        for n in book["notes"]:
            if where[n["id"]] == i:
                body += f'\n<aside epub:type="footnote" id="{xml_id(n["id"], ids)}">{rewritten(n["html"], change)}</aside>'
        cls = ' class="vertical"' if vertical else ""
        out.append((f, XHTML.format(lang=escape_attribute(lang), title=escape_text(c["title"] or book["meta"]["title"]), cls=cls, body=body)))
    return out, place


def contents_label(language: str | None) -> str:
    return {"zh": "目录", "ja": "目次"}.get((language or "").lower()[:2], "Contents")


def navigation(book: dict, place: dict[str, str]) -> tuple[str, str]:
    """The nav document and the NCX."""
    count = [0]

    def href(n: dict) -> str:
        return escape_attribute(quote(place[n["target"]]) + (f"#{n['anchor']}" if n["anchor"] else ""))

    def items(parent: str | None) -> str:
        rows = [n for n in children(book, parent) if n["target"] in place]
        return "<ol>" + "".join(f'<li><a href="{href(n)}">{escape_text(n["title"] or "")}</a>{items(n["id"])}</li>' for n in rows) + "</ol>" if rows else ""

    def points(parent: str | None) -> str:
        out = []
        for n in (n for n in children(book, parent) if n["target"] in place):
            count[0] += 1
            out.append(f'<navPoint id="np-{count[0]}" playOrder="{count[0]}"><navLabel><text>{escape_text(n["title"] or "")}</text></navLabel><content src="{href(n)}"/>{points(n["id"])}</navPoint>')
        return "".join(out)

    meta = book["meta"]
    label = contents_label(meta["language"])
    nav = XHTML.format(lang=escape_attribute(meta["language"]), title=label, cls="", body=f'<nav epub:type="toc" id="toc"><h1>{label}</h1>{items(None) or "<ol></ol>"}</nav>')
    toc = f'<?xml version="1.0" encoding="utf-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="{escape_attribute(meta["identifier"])}"/></head><docTitle><text>{escape_text(meta["title"])}</text></docTitle><navMap>{points(None)}</navMap></ncx>\n'
    return nav, toc


def package(book: dict, files: list[str], modified: str) -> str:
    meta = book["meta"]
    rows = [f'<dc:identifier id="uid">{escape_text(meta["identifier"])}</dc:identifier>', f"<dc:title>{escape_text(meta['title'])}</dc:title>", f"<dc:language>{escape_text(meta['language'])}</dc:language>"]
    rows += [f"<dc:{tag}>{escape_text(meta[k])}</dc:{tag}>" for tag, k in (("creator", "author"), ("publisher", "publisher"), ("date", "date"), ("description", "description")) if meta[k]]
    rows.append(f'<meta property="dcterms:modified">{modified}</meta>')
    if book["cover"]:
        rows.append(f'<meta name="cover" content="{escape_attribute(book["cover"])}"/>')
    items = ['<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>', '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>', '<item id="css" href="style.css" media-type="text/css"/>']
    items += [f'<item id="chap-{i}" href="{escape_attribute(quote(f))}" media-type="application/xhtml+xml"/>' for i, f in enumerate(files, 1)]
    items += [f'<item id="{escape_attribute(r["id"])}" href="{escape_attribute(quote(r["href"]))}" media-type="{escape_attribute(r["mime"])}"{" properties=%scover-image%s" % (chr(34), chr(34)) if r["id"] == book["cover"] else ""}/>' for r in book["resources"]]
    refs = "".join(f'<itemref idref="chap-{i}"/>' for i in range(1, len(files) + 1))
    rtl = ' page-progression-direction="rtl"' if meta["writing_mode"] == VERTICAL else ""
    return f'<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="uid"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">{"".join(rows)}</metadata><manifest>{"".join(items)}</manifest><spine toc="ncx"{rtl}>{refs}</spine></package>\n'


CONTAINER = '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>\n'


def write(book: dict, modified: str = MODIFIED, change=lambda xhtml: xhtml) -> bytes:
    docs, place = documents(book)
    nav, toc = navigation(book, place)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:

        def put(name: str, data: str | bytes, method: int = zipfile.ZIP_DEFLATED) -> None:
            z.writestr(zipfile.ZipInfo(name, EPOCH), data, method)

        put("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        put("META-INF/container.xml", CONTAINER)
        put("content.opf", package(book, [f for f, _ in docs], modified))
        put("nav.xhtml", nav)
        put("toc.ncx", toc)
        put("style.css", CSS)
        for f, xhtml in docs:
            put(f, change(xhtml))
        for r in book["resources"]:
            put(r["href"], r["data"])
    return buffer.getvalue()


# KEPUB

_CUT = re.compile(f"[{T.ENDERS}][{re.escape(T.CLOSERS)}]*|[.!?](?:[{re.escape(JS_SPACE)}]+|$)")
_PIECE = re.compile(r"<!--.*?-->|<[^>]*>|[^<]+", re.S)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote td th dt dd figcaption div aside pre".split())
BARE = frozenset(("rt", "rp", "script", "style"))


def sentences(text: str) -> list[str]:
    ends = [m.end() for m in _CUT.finditer(text)]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True) if a < b]


def with_spans(xhtml: str) -> str:
    """Each sentence of the body in a span kobo.<paragraph>.<sentence>; blanks are left alone."""
    m = re.search(r"(<body(?:\s[^>]*)?>)(.*)(</body>)", xhtml, re.S)
    if not m:
        return xhtml
    out, number, stack = [], 0, [[0, 0]]
    bare = 0
    for part in _PIECE.findall(m[2]):
        if part[0] == "<":
            tag = re.match(r"</?([A-Za-z0-9:]+)", part)
            name = tag[1].lower() if tag else ""
            if name in BARE:
                bare += -1 if part[1] == "/" else 1
            if name in PARAGRAPHS and not part.endswith("/>"):
                if part[1] != "/":
                    number += 1
                    stack.append([number, 0])
                elif len(stack) > 1:
                    stack.pop()
            out.append(part)
            continue
        for piece in [part] if bare else sentences(part):
            if bare or not piece.strip(JS_SPACE):
                out.append(piece)
                continue
            if not stack[-1][0]:
                number += 1
                stack[-1] = [number, 0]
            stack[-1][1] += 1
            out.append(f'<span class="koboSpan" id="kobo.{stack[-1][0]}.{stack[-1][1]}">{piece}</span>')
    return xhtml[: m.start(2)] + "".join(out) + xhtml[m.end(2) :]


def write_kepub(book: dict, modified: str = MODIFIED) -> bytes:
    return write(book, modified, with_spans)
