"""Plain text and printable HTML."""

from __future__ import annotations

import base64

from quire.functions.markup import escape_attribute, escape_text, plain_text, rewritten
from quire.schema import VERTICAL
from quire.sinks.epub import children, heading_text

BOM = b"\xef\xbb\xbf"


def write_txt(book: dict) -> bytes:
    """Title and text of each chapter, empty ones left out."""
    out = []
    for c in book["chapters"]:
        parts = [x for x in (c["title"], plain_text(c["html"])) if x]
        if parts:
            if len(parts) == 2 and parts[1].startswith(parts[0] + "\n"):
                parts = parts[1:]
            out.append("\n\n".join(parts))
    return BOM + "\n\n".join(out).encode()


CSS = (
    "@page{{size:A5;margin:18mm 15mm;@bottom-center{{content:counter(page)}}}}body{{font-family:serif;line-height:1.7;writing-mode:{mode}}}"
    "section{{break-before:page}}img{{max-width:100%}}nav ol{{list-style:none}}"
)


def write_html(book: dict) -> bytes:
    """One page to print: title, contents, chapters, notes, images as data URIs. Images that aren't there stay as
    they are."""
    meta = book["meta"]
    uris = {r["href"]: f"data:{r['mime']};base64,{base64.b64encode(r['data']).decode()}" for r in book["resources"]}

    def change(tag: str, attrs: list[tuple[str, str]]):
        return [(k, uris.get(v, v) if tag == "img" and k == "src" else v) for k, v in attrs]

    def contents(parent: str | None) -> str:
        rows = children(book, parent)
        return f"<ol>{''.join(f'<li><a href="#{escape_attribute(n["target"])}">{escape_text(n["title"] or "")}</a>{contents(n["id"])}</li>' for n in rows)}</ol>" if rows else ""

    body = [f"<header><h1>{escape_text(meta['title'])}</h1>{f'<p>{escape_text(meta["author"])}</p>' if meta['author'] else ''}</header>"]
    if toc := contents(None):
        body.append(f"<nav>{toc}</nav>")
    for c in book["chapters"]:
        html = rewritten(c["html"], change)
        if c["title"] and heading_text(c["html"]) != c["title"].strip():
            html = f"<h{c['level']}>{escape_text(c['title'])}</h{c['level']}>{html}"
        body.append(f'<section id="{escape_attribute(c["id"])}">{html}</section>')
    if book["notes"]:
        body.append('<section class="notes">' + "".join(f'<aside id="{escape_attribute(n["id"])}">{rewritten(n["html"], change)}</aside>' for n in book["notes"]) + "</section>")
    css = CSS.format(mode="vertical-rl" if meta["writing_mode"] == VERTICAL else "horizontal-tb")
    return f'<!DOCTYPE html>\n<html lang="{escape_attribute(meta["language"])}"><head><meta charset="utf-8"><title>{escape_text(meta["title"])}</title><style>{css}</style></head><body>{"".join(body)}</body></html>\n'.encode()
