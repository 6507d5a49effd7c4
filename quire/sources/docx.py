"""Word documents: paragraphs, headings, emphasis, images and footnotes straight from the package's XML."""

from __future__ import annotations

import re

from quire.functions.markup import Node, escape_attribute, escape_text, plain_text, xml
from quire.model import BookError, chapter, nav_from_levels, new_book, stem, warn
from quire.sources.archive import opened
from quire.sources.markdown import mime_of

SIGNATURES = (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08")


def heading_level(style: str | None) -> int:
    m = re.fullmatch(r"(?:heading|berschrift|titre)?\s*([1-3])", (style or "").lower().replace("ü", ""))
    return int(m[1]) if m and style else 0


class Document:
    def __init__(self, data: bytes):
        self.zip = opened(data)
        self.links = {n.get("Id"): n.get("Target") for n in self.part("word/_rels/document.xml.rels").all("Relationship")}
        self.images: dict[str, dict] = {}
        self.notes: list[str] = []

    def part(self, name: str) -> Node:
        return xml(self.zip.read(name).decode("utf-8", "replace")) if name in self.zip.namelist() else Node("", {})

    def run(self, r: Node) -> str:
        out = []
        for c in r.children:
            if isinstance(c, str):
                continue
            if c.name == "t":
                out.append(escape_text(c.text))
            elif c.name in ("br", "cr"):
                out.append("<br />")
            elif c.name == "tab":
                out.append(" ")
            elif c.name in ("footnoteReference", "endnoteReference") and c.get("id"):
                key = f"{c.name[:-9]}-{c.get('id')}"
                if key not in self.notes:
                    self.notes.append(key)
                out.append(f'<a class="noteref" href="#{escape_attribute(key)}">{self.notes.index(key) + 1}</a>')
            elif c.name in ("drawing", "pict"):
                out += [self.image(b.get("embed") or b.get("id")) for b in c.all("blip", "imagedata")]
        html = "".join(out)
        p = next((c for c in r.children if isinstance(c, Node) and c.name == "rPr"), None)
        on = lambda n: p is not None and (x := p.first(n)) is not None and x.get("val", "1") not in ("0", "false", "none")
        for name, tag in (("b", "strong"), ("i", "em"), ("u", "u"), ("strike", "s")):
            if html.strip() and on(name):
                html = f"<{tag}>{html}</{tag}>"
        return html

    def image(self, rel: str | None) -> str:
        target = self.links.get(rel or "")
        path = f"word/{target}" if target and not target.startswith("/") else (target or "").lstrip("/")
        if path not in self.zip.namelist():
            return ""
        if path not in self.images:
            n = len(self.images) + 1
            self.images[path] = {"id": f"img{n}", "href": f"images/img-{n}.{path.rpartition('.')[2].lower()}", "mime": mime_of(path), "data": self.zip.read(path)}
        return f'<img src="{self.images[path]["href"]}" alt="" />'

    def inline(self, p: Node) -> str:
        out = []
        for c in p.children:
            if isinstance(c, Node):
                if c.name == "r":
                    out.append(self.run(c))
                elif c.name == "hyperlink":
                    href = self.links.get(c.get("id") or "")
                    inner = self.inline(c)
                    out.append(f'<a href="{escape_attribute(href)}">{inner}</a>' if href else inner)
                elif c.name in ("ins", "smartTag", "sdt", "sdtContent"):
                    out.append(self.inline(c))
        return "".join(out)

    def blocks(self, body: Node):
        """(heading level or 0, html) of each block."""
        items: list[str] = []
        for c in body.children:
            if not isinstance(c, Node):
                continue
            if c.name == "p":
                style = c.first("pStyle")
                html = self.inline(c)
                level = heading_level(style.get("val") if style else None)
                if c.first("numPr") and not level:
                    items.append(f"<li>{html}</li>")
                    continue
                if items:
                    yield 0, f"<ul>{''.join(items)}</ul>"
                    items = []
                if level or html.strip():
                    yield level, html if level else f"<p>{html}</p>"
            elif c.name == "tbl":
                rows = "".join(f"<tr>{''.join(f'<td>{"".join(h for _, h in self.blocks(d))}</td>' for d in r.children if isinstance(d, Node) and d.name == 'tc')}</tr>" for r in c.children if isinstance(r, Node) and r.name == "tr")
                yield 0, f"<table><tbody>{rows}</tbody></table>"
            elif c.name in ("sdt", "sdtContent"):
                yield from self.blocks(c)
        if items:
            yield 0, f"<ul>{''.join(items)}</ul>"


def read(data: bytes, name: str) -> dict:
    if not data.startswith(SIGNATURES):
        raise BookError("no Word document")
    d = Document(data)
    body = d.part("word/document.xml").first("body")
    if body is None:
        raise BookError("no document part")
    core = d.part("docProps/core.xml")
    text = lambda *names: next((t for n in core.all(*names) if (t := n.text.strip())), None)
    book = new_book(name, data, title=text("title") or stem(name), author=text("creator"), description=text("description", "subject"), language=text("language"), publisher=text("publisher"), date=text("created"))
    title, level, held, found = None, 1, [], False
    for rank, html in [*d.blocks(body), (-1, "")]:
        if not rank:
            held.append(html)
            continue
        if title is not None or plain_text("".join(held)):
            chapter(book, title, "\n".join(held), level)
        title, level, held = re.sub(r"<[^>]*>", "", html).strip() or None, max(1, rank), []
        found |= rank > 0
    if not book["chapters"]:
        chapter(book, None, "")
    if not found:
        warn(book, "docx.no-headings")
    for kind in ("footnote", "endnote"):
        for n in d.part(f"word/{kind}s.xml").all(kind):
            if (key := f"{kind}-{n.get('id')}") in d.notes:
                book["notes"].append({"id": key, "html": "".join(h for _, h in d.blocks(n))})
    known = {n["id"] for n in book["notes"]}
    for c in book["chapters"]:
        c["html"] = re.sub(r'<a class="noteref" href="#([^"]*)">(.*?)</a>', lambda m: m[0] if m[1] in known else m[2], c["html"])
    book["resources"] = list(d.images.values())
    nav_from_levels(book)
    return book
