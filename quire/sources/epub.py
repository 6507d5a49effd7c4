"""EPUB 2 and 3: package, spine, navigation, footnotes, images, links."""

from __future__ import annotations

import posixpath
import re
import zipfile
from urllib.parse import unquote

from quire.functions.markup import Node, decode_entities, is_external, plain_text, rewritten, sanitize, xml
from quire.model import BookError, chapter, nav_from_levels, new_book, stem, warn
from quire.schema import VERTICAL
from quire.sources.archive import opened

NOTE_TYPES = frozenset(("footnote", "endnote", "rearnote", "note"))
FONT = re.compile(r"\.(?:otf|ttf|woff2?)$", re.I)


class Package:
    def __init__(self, data: bytes):
        self.zip = opened(data)
        self.names = self.zip.namelist()
        self.low = {}
        for n in self.names:
            self.low.setdefault(n.lower(), n)

    def find(self, path: str) -> str | None:
        """The entry of this path, else the first that differs in case only."""
        return path if path in self.names else self.low.get(path.lower())

    def text(self, path: str) -> str | None:
        name = self.find(path)
        return None if name is None else self.zip.read(name).decode("utf-8-sig", "replace")


def resolved(base: str, href: str) -> str:
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(href.partition("#")[0]))).lstrip("/")


def check_encryption(p: Package, book: dict) -> None:
    text = p.text("META-INF/encryption.xml")
    if not text:
        return
    locked = [unquote(n.get("URI", "")) for n in xml(text).all("CipherReference")]
    if any(not FONT.search(x) for x in locked):
        raise BookError("the book is encrypted")
    if locked:
        warn(book, "epub.encrypted")


def metadata(opf: Node, book: dict) -> str | None:
    """Fills the book's metadata; returns the manifest id of the cover that it names."""
    part = opf.first("metadata") or Node("metadata", {})
    texts = lambda name: [t for n in part.all(name) if (t := re.sub(r"\s+", " ", n.text).strip())]
    first = lambda name: next(iter(texts(name)), None)
    found = {k: first(k) for k in ("title", "language", "publisher", "date", "description")}
    found["author"] = "、".join(texts("creator")) or None
    unique = (opf.first("package") or Node("", {})).get("unique-identifier")
    ids = [n for n in part.all("identifier") if n.text.strip()]
    named = next((n for n in ids if unique and n.get("id") == unique), ids[0] if ids else None)
    found["identifier"] = named.text.strip() if named else None
    book["meta"] |= {k: v for k, v in found.items() if v}
    return next((n.get("content") for n in part.all("meta") if n.get("name") == "cover"), None)


def navigation(doc: Node) -> list[tuple[str, str, list]]:
    """(title, href, children) of the nav element for the table of contents."""
    navs = list(doc.all("nav"))
    own = next((n for n in navs if "toc" in (n.get("type") or "").split()), navs[0] if navs else None)
    line = lambda n: re.sub(r"\s+", " ", n.text).strip()

    def entries(ol: Node) -> list:
        out = []
        for li in (c for c in ol.children if isinstance(c, Node) and c.name == "li"):
            parts = [c for c in li.children if isinstance(c, Node)]
            label = next((c for c in parts if c.name in ("a", "span")), None) or next((x for c in parts if c.name != "ol" for x in c.all("a")), None)
            inner = next((c for c in parts if c.name == "ol"), None)
            out.append((line(label) if label else "", (label.get("href") if label else None) or "", entries(inner) if inner else []))
        return out

    top = own.first("ol") if own else None
    return entries(top) if top else []


def ncx(doc: Node) -> list[tuple[str, str, list]]:
    def points(node: Node) -> list:
        out = []
        for p in (c for c in node.children if isinstance(c, Node) and c.name == "navPoint"):
            label, content = p.first("text"), p.first("content")
            out.append((re.sub(r"\s+", " ", label.text).strip() if label else "", (content.get("src") if content else None) or "", points(p)))
        return out

    m = doc.first("navMap")
    return points(m) if m else []


def body_of(text: str) -> str:
    m = re.search(r"<body(?:\s[^>]*)?>(.*)</body\s*>", text, re.S | re.I)
    text = m[1] if m else text
    one = lambda s: f'<img src="{m2[1] or m2[2]}" />' if (m2 := re.search(r"<image\b[^>]*?(?:xlink:)?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", s[0], re.I)) else ""
    return re.sub(r"<svg\b.*?</svg\s*>", one, text, flags=re.S | re.I)


def first_heading(html: str) -> str | None:
    m = re.search(r"<h[1-6](?:\s[^>]*)?>(.*?)</h[1-6]\s*>", html, re.S | re.I)
    return (re.sub(r"\s+", " ", decode_entities(re.sub(r"<[^>]*>", "", m[1]))).strip() or None) if m else None


_NOTE = re.compile(r"<(aside|div|section)\b([^>]*)>", re.I)


def take_notes(html: str) -> tuple[str, dict[str, str]]:
    """Footnote elements that have an id, cut out of the html."""
    found, at = {}, 0
    while m := _NOTE.search(html, at):
        kinds = re.search(r"epub:type\s*=\s*[\"']([^\"']*)", m[2])
        own = re.search(r"\bid\s*=\s*[\"']([^\"']*)", m[2])
        if not (kinds and own and NOTE_TYPES & set(kinds[1].lower().split())):
            at = m.end()
            continue
        depth, end, close = 1, len(html), len(html)
        for t in re.finditer(rf"<(/?){m[1]}\b[^>]*?(/?)>", html[m.end() :], re.I):
            depth += -1 if t[1] else 0 if t[2] else 1
            if not depth:
                close, end = m.end() + t.start(), m.end() + t.end()
                break
        found[own[1]] = html[m.end() : close]
        html = html[: m.start()] + html[end:]
        at = m.start()
    return html, found


def read(data: bytes, name: str) -> dict:
    p = Package(data)
    book = new_book(name, data, title=stem(name))
    check_encryption(p, book)
    container = xml(p.text("META-INF/container.xml") or "")
    path = next((r.get("full-path") for r in container.all("rootfile") if r.get("full-path")), None)
    source = p.text(path) if path else None
    if source is None:
        raise BookError("no package document")
    opf = xml(source)
    cover_id = metadata(opf, book)
    items = {n.get("id"): n for n in (opf.first("manifest") or Node("", {})).all("item") if n.get("id") and n.get("href")}
    spine = opf.first("spine") or Node("spine", {})
    if spine.get("page-progression-direction") == "rtl":
        book["meta"]["writing_mode"] = VERTICAL
    at = {i: resolved(path, n.get("href")) for i, n in items.items()}

    resources: dict[str, dict] = {}

    def resource(where: str) -> dict | None:
        entry = p.find(where)
        if entry is None:
            return None
        if entry not in resources:
            iid = next((i for i, w in at.items() if w.lower() == entry.lower()), None)
            mime = items[iid].get("media-type") if iid else None
            from quire.sources.markdown import mime_of

            resources[entry] = {"id": f"res-{len(resources) + 1}", "href": entry, "mime": mime or mime_of(entry), "data": p.zip.read(entry)}
        return resources[entry]

    parts, chapter_of, lost = [], {}, set()
    for ref in spine.all("itemref"):
        where = at.get(ref.get("idref"))
        text = p.text(where) if where else None
        if text is None:
            warn(book, "epub.broken-spine-item", ref.get("idref"))
            continue
        html, notes = take_notes(body_of(text))
        c = chapter(book, None, "", prefix="ch")
        chapter_of[where] = c["id"]
        numbers = {k: f"n{len(book['notes']) + i + 1}" for i, k in enumerate(notes)}
        book["notes"] += [{"id": numbers[k], "html": v} for k, v in notes.items()]
        parts.append((c, where, html, numbers))
    if not parts:
        raise BookError("the spine holds no document")

    def finished(html: str, where: str, numbers: dict[str, str]) -> str:
        def change(tag: str, attrs: list[tuple[str, str]]):
            a = dict(attrs)
            if tag == "img":
                r = None if is_external(a.get("src", "")) else resource(resolved(where, a.get("src", "")))
                if r is None:
                    lost.add(a.get("src", ""))
                    return ""
                return [(k, r["href"] if k == "src" else v) for k, v in attrs]
            if tag == "a" and "href" in a and not is_external(a["href"]):
                target, _, anchor = a["href"].partition("#")
                if anchor in numbers and (not target or resolved(where, target) == where):
                    rest = [(k, f"#{numbers[anchor]}" if k == "href" else v) for k, v in attrs if k not in ("class", "epub:type")]
                    names = [*(n for n in a.get("class", "").split() if n != "noteref"), "noteref"]
                    return [("class", " ".join(names)), *rest]
                if target and resolved(where, target) != where:
                    to = chapter_of.get(resolved(where, target))
                    return None if to is None else [(k, f"#{to}" if k == "href" else v) for k, v in attrs]
                return [(k, f"#{anchor}" if k == "href" else v) for k, v in attrs] if anchor else None
            return attrs

        return sanitize(rewritten(html, change))

    for c, where, html, numbers in parts:
        c["html"], c["title"] = finished(html, where, numbers), first_heading(html)
        for k, n in numbers.items():
            note = next(x for x in book["notes"] if x["id"] == n)
            note["html"] = finished(note["html"], where, numbers)

    toc = next((i for i, n in items.items() if "nav" in (n.get("properties") or "").split()), None)
    if toc and (text := p.text(at[toc])):
        entries, base = navigation(xml(text)), at[toc]
    else:
        toc = spine.get("toc") if spine.get("toc") in at else next((i for i, n in items.items() if "dtbncx" in (n.get("media-type") or "")), None)
        entries, base = (ncx(xml(p.text(at[toc]) or "")), at[toc]) if toc else ([], "")

    def add(rows: list, parent: str | None, depth: int) -> None:
        for title, href, inner in rows:
            target = chapter_of.get(resolved(base, href)) if href else None
            node = parent
            if target:  # an entry that leads nowhere goes; its children move up, and keep the level of their nesting
                node = f"n{len(book['nav']) + 1}"
                book["nav"].append({"id": node, "parent": parent, "title": title, "target": target, "anchor": href.partition("#")[2] or None, "level": min(3, depth)})
            add(inner, node, depth + 1)

    add(entries, None, 1)
    for c in book["chapters"]:
        own = [n for n in book["nav"] if n["target"] == c["id"] and not n["anchor"]]
        if own:
            c["level"] = min(n["level"] for n in own)
            c["title"] = c["title"] or own[0]["title"] or None
    if not book["nav"]:
        warn(book, "epub.no-toc")
        nav_from_levels(book)
    marked = next((i for i, n in items.items() if "cover-image" in (n.get("properties") or "").split()), None) or (cover_id if cover_id in items else None)
    if marked and (items[marked].get("media-type") or "").startswith("image/") and (r := resource(at[marked])):
        book["cover"] = r["id"]
    if lost:
        warn(book, "epub.missing-image", str(len(lost)))
    book["resources"] = list(resources.values())
    if not any(plain_text(c["html"]) or "<img" in c["html"] for c in book["chapters"]):
        warn(book, "epub.empty")
    return book


def is_epub(data: bytes) -> bool:
    try:
        return "META-INF/container.xml" in opened(data).namelist()
    except (BookError, zipfile.BadZipFile):
        return False
