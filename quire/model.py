"""A book as one nested row, and the same as a dict while Python works on it."""

from __future__ import annotations

import hashlib
import uuid

from quire.functions.markup import is_external, tokens
from quire.schema import ALLOWED_TAGS, HORIZONTAL, LANGUAGE, UNTITLED, VERTICAL

META = ("title", "author", "language", "identifier", "publisher", "date", "description", "writing_mode")
BOOK = (
    f"src_path string, meta struct<{','.join(f'{m}:string' for m in META)}>, cover string, "
    "chapters array<struct<id:string,title:string,level:int,html:string>>, "
    "resources array<struct<id:string,href:string,mime:string,data:binary>>, "
    "nav array<struct<id:string,parent:string,title:string,target:string,anchor:string,level:int>>, "
    "notes array<struct<id:string,html:string>>, warnings array<struct<code:string,detail:string>>, failure string"
)


class BookError(ValueError):
    """A file that can't be read; the message says why."""


def new_book(name: str, data: bytes = b"", **meta: str | None) -> dict:
    """The identifier follows from the content, so that a repeated job gives the same book."""
    own = dict.fromkeys(META)
    own |= {"title": UNTITLED, "language": LANGUAGE, "writing_mode": HORIZONTAL}
    own["identifier"] = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, hashlib.sha256(data).hexdigest() + name)}"
    own |= {k: v for k, v in meta.items() if v}
    if own["writing_mode"] not in (HORIZONTAL, VERTICAL):
        own["writing_mode"] = HORIZONTAL
    return {"src_path": name, "meta": own, "cover": None, "chapters": [], "resources": [], "nav": [], "notes": [], "warnings": [], "failure": None}


def failed(name: str, message: str) -> dict:
    return new_book(name) | {"failure": message}


def warn(book: dict, code: str, detail: str | None = None) -> None:
    w = {"code": code, "detail": detail}
    if w not in book["warnings"]:
        book["warnings"].append(w)


def chapter(book: dict, title: str | None, html: str, level: int = 1, prefix: str = "c") -> dict:
    c = {"id": f"{prefix}{len(book['chapters']) + 1}", "title": title, "level": min(3, max(1, level)), "html": html}
    book["chapters"].append(c)
    return c


def nav_from_levels(book: dict) -> None:
    """Navigation from titled chapters: an entry belongs to the nearest one before it of a smaller level."""
    open_: list[dict] = []
    for c in book["chapters"]:
        if c["title"] is None:
            continue
        while open_ and open_[-1]["level"] >= c["level"]:
            open_.pop()
        entry = {"id": f"n{len(book['nav']) + 1}", "parent": open_[-1]["id"] if open_ else None, "title": c["title"], "target": c["id"], "anchor": None, "level": c["level"]}
        book["nav"].append(entry)
        open_.append(entry)


def stem(name: str) -> str:
    base = name.replace("\\", "/").rpartition("/")[2]
    return base.rpartition(".")[0] or base


def validate(book: dict) -> list[str]:
    """All that is wrong with a book, in the order of its parts."""
    out = [f"no {k}" for k in ("title", "language", "identifier") if not (book["meta"].get(k) or "").strip()]
    if book["meta"].get("writing_mode") not in (HORIZONTAL, VERTICAL):
        out.append("writing mode")
    out += [f"resource {r['id']}" for r in book["resources"] if not r["href"] or not r["mime"] or r["data"] is None]
    if book["cover"] and book["cover"] not in {r["id"] for r in book["resources"]}:
        out.append("cover")
    if not book["chapters"]:
        out.append("no chapter")
    seen: set[str] = set()
    hrefs, notes = {r["href"] for r in book["resources"]}, {n["id"] for n in book["notes"]}
    for c in book["chapters"]:
        if c["id"] in seen:
            out.append(f"chapter {c['id']} twice")
        seen.add(c["id"])
        if c["level"] not in (1, 2, 3):
            out.append(f"level of {c['id']}")
        found = [t for t in tokens(c["html"]) if t[0] != "text"]
        out += [f"tag {t} in {c['id']}" for t in dict.fromkeys(t[1] for t in found) if t not in ALLOWED_TAGS]
        for t in found:
            attrs = dict(t[2]) if t[0] == "open" else {}
            src, href = attrs.get("src"), attrs.get("href", "")
            if t[1] == "img" and src is not None and (is_external(src) or src not in hrefs):
                out.append(f"image {src} in {c['id']}")
            if t[1] == "a" and "noteref" in attrs.get("class", "").split() and href[1:] not in notes:
                out.append(f"note {href} in {c['id']}")
    return out + [f"navigation to {n['target']}" for n in book["nav"] if n["target"] not in seen]
