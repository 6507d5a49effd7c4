"""Markdown: sections at ATX headings, blocks and inline marks as restricted HTML."""

from __future__ import annotations

import re
from urllib.parse import unquote

from quire.functions import text as T
from quire.functions.markup import JS_SPACE, escape_attribute, escape_text, rewritten
from quire.model import chapter, nav_from_levels, new_book, stem, warn

_ATX = re.compile(r"(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
_FENCE = re.compile(r"[ ]{0,3}(`{3,}|~{3,})")
_ITEM = re.compile(r"[ ]{0,3}([-*+]|\d+[.)])[ \t]+(.*)")


def slug(title: str) -> str:
    low = re.sub(f"[{re.escape(JS_SPACE)}]+", "-", title.strip(JS_SPACE).lower())
    return "".join(c for c in low if c == "-" or c.isalpha() or c.isnumeric())


def bare(title: str) -> str:
    """A heading's text without marks."""
    title = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", title)
    return re.sub(r"[*_`~]", "", title).strip()


def inline(text: str) -> str:
    """Code first, then images, links, bold and italic. Code is escaped once."""
    stash: list[str] = []

    def keep(html: str) -> str:
        stash.append(html)
        return f"\x00{len(stash) - 1}\x00"

    text = re.sub(r"(`+)(.+?)\1", lambda m: keep(f"<code>{escape_text(m[2].strip())}</code>"), text.replace("\x00", ""))
    text = escape_text(text)
    quote = lambda s: escape_attribute(s.replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">"))
    text = re.sub(r"!\[([^\]]*)\]\(\s*(\S+?)(?:\s+[\"'].*?[\"'])?\s*\)", lambda m: keep(f'<img src="{quote(m[2])}" alt="{quote(m[1])}" />'), text)
    text = re.sub(r"\[([^\]]*)\]\(\s*(\S+?)(?:\s+[\"'].*?[\"'])?\s*\)", lambda m: f"{keep(f'<a href="{quote(m[2])}">')}{m[1]}</a>", text)
    text = re.sub(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"<strong>\2</strong>", text)
    text = re.sub(r"\*(?=\S)(.+?)(?<=\S)\*", r"<em>\1</em>", text)
    text = re.sub(r"(?<![^\W_])_(?=\S)(.+?)(?<=\S)_(?![^\W_])", r"<em>\1</em>", text)
    while "\x00" in text:
        text = re.sub("\x00(\\d+)\x00", lambda m: stash[int(m[1])], text)
    return text


def is_rule(line: str) -> bool:
    marks = re.sub(r"\s", "", line)
    return len(marks) >= 3 and marks[0] in "-*_" and set(marks) == {marks[0]}


def blocks(lines: list[str]) -> str:
    out: list[str] = []
    at = 0
    while at < len(lines):
        line = lines[at]
        if m := _FENCE.match(line):
            end = next((k for k in range(at + 1, len(lines)) if lines[k].strip().startswith(m[1]) and not lines[k].strip().strip(m[1][0])), len(lines))
            out.append(f"<pre><code>{escape_text(chr(10).join(lines[at + 1 : end]))}</code></pre>")
            at = end + 1
        elif line.lstrip().startswith(">"):
            end = at
            while end < len(lines) and lines[end].lstrip().startswith(">"):
                end += 1
            out.append(f"<blockquote>{blocks([re.sub(r'^\s*> ?', '', x) for x in lines[at:end]])}</blockquote>")
            at = end
        elif is_rule(line):
            out.append("<hr />")
            at += 1
        elif m := _ITEM.match(line):
            ordered = m[1][0].isdigit()
            items: list[str] = []
            while at < len(lines) and (m := _ITEM.match(lines[at])) and m[1][0].isdigit() == ordered and not is_rule(lines[at]):
                own = [m[2]]
                at += 1
                while at < len(lines) and lines[at].strip() and lines[at][0] in " \t" and not _ITEM.match(lines[at]):
                    own.append(lines[at].strip())
                    at += 1
                items.append(f"<li>{inline(' '.join(own))}</li>")
            tag = "ol" if ordered else "ul"
            out.append(f"<{tag}>{''.join(items)}</{tag}>")
        elif not line.strip(JS_SPACE):
            at += 1
        else:
            end = at + 1
            while end < len(lines) and lines[end].strip(JS_SPACE) and not (_FENCE.match(lines[end]) or lines[end].lstrip().startswith(">") or is_rule(lines[end]) or _ITEM.match(lines[end])):
                end += 1
            out.append(f"<p>{inline(' '.join(x.strip() for x in lines[at:end]))}</p>")
            at = end
    return "\n".join(out)


def sections(text: str) -> list[tuple[str | None, int, list[str]]]:
    """(title, level, lines); headings within fences are lines. A blank section without title goes unless alone."""
    out: list[tuple[str | None, int, list[str]]] = [(None, 1, [])]
    fence = None
    for line in text.split("\n"):
        if fence:
            if line.strip().startswith(fence) and not line.strip().strip(fence[0]):
                fence = None
        elif m := _FENCE.match(line):
            fence = m[1]
        elif m := _ATX.match(line):
            out.append((bare(m[2]), min(3, len(m[1])), []))
            continue
        out[-1][2].append(line)
    return [s for s in out if s[0] is not None or any(x.strip(JS_SPACE) for x in s[2]) or len(out) == 1]


def asset_keys(src: str) -> list[str]:
    plain = unquote(src)
    return [src, plain, re.sub(r"^(\./|/)+", "", plain), plain.rpartition("/")[2]]


def read(data: bytes, name: str, assets: dict[str, tuple[str, bytes]] | None = None) -> dict:
    """assets: images (mime, data) by path beside the file."""
    text = re.sub(r"\r\n?", "\n", data.decode("utf-8", "replace").removeprefix("\ufeff"))
    book = new_book(name, data, title=stem(name))
    found = sections(text)
    slugs: dict[str, str] = {}
    for title, level, lines in found:
        c = chapter(book, title, blocks(lines), level, "ch")
        if title is not None:
            slugs.setdefault(slug(title), c["id"])
    titled = [c["title"] for c in book["chapters"] if c["title"]]
    if titled:
        book["meta"]["title"] = titled[0]
        nav_from_levels(book)
    else:
        warn(book, "md.no-chapters")
    taken: dict[str, str] = {}

    def change(tag: str, attrs: list[tuple[str, str]]):
        a = dict(attrs)
        if tag == "a" and a.get("href", "").startswith("#"):
            target = slugs.get(unquote(a["href"][1:])) or slugs.get(slug(unquote(a["href"][1:])))
            return [("href", f"#{target}")] if target else attrs
        if tag == "img":
            src = a.get("src", "")
            key = next((k for k in asset_keys(src) if assets and k in assets), None)
            if key is None:
                warn(book, "md.image-unresolved", src[:120])
                return ""
            if key not in taken:
                mime, body = assets[key]
                rid = f"img{len(taken) + 1}"
                taken[key] = f"images/{rid}.{key.rpartition('.')[2].lower()}"
                book["resources"].append({"id": rid, "href": taken[key], "mime": mime, "data": body})
            return [("src", taken[key]), ("alt", a.get("alt", ""))]
        return attrs

    for c in book["chapters"]:
        c["html"] = rewritten(c["html"], change)
    return book


def mime_of(path: str) -> str:
    return T.MIME_BY_EXTENSION.get(path.rpartition(".")[2].lower(), "application/octet-stream")
