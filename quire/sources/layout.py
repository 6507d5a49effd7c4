"""Positioned text runs, as a PDF engine gives them, to lines. Runs come as rows; the engine is the caller's."""

from __future__ import annotations

import re

from quire.functions.markup import escape_text
from quire.model import BookError, chapter, new_book, stem, warn
from quire.operators.segment import CHAPTER_GAP, INDENT, LINE_HEIGHT, PAGES, PARAGRAPH_GAP

LEAST_CHARACTERS = 20
_CJK = re.compile("[　-鿿豈-﫿＀-￯]")


def joined(parts: list[str]) -> str:
    """Pieces of a line or paragraph: CJK neighbours touch, others get a space."""
    out = ""
    for p in parts:
        close = not out or not p or out[-1].isspace() or p[0].isspace() or (_CJK.match(out[-1]) and _CJK.match(p[0]))
        out += p if close else " " + p
    return out


def lines(runs: list[dict]) -> list[dict]:
    """Runs (str, x, y, width, font) of a page to lines (text, x0, y, font), top down. A run belongs to a line if
    its height is near that of the line's first run."""
    out: list[list[dict]] = []
    for r in sorted((r for r in runs if r["str"]), key=lambda r: (-r["y"], r["x"])):
        if out and abs(out[-1][0]["y"] - r["y"]) <= max(2, 0.5 * (out[-1][0]["font"] or 0)):
            out[-1].append(r)
        else:
            out.append([r])
    made = []
    for row in out:
        row.sort(key=lambda r: r["x"])
        text = joined([r["str"] for r in row]).strip()
        if text:
            made.append({"text": text, "x0": row[0]["x"], "y": row[0]["y"], "font": max(r["font"] for r in row)})
    return made


def read(pages: list[list[dict]], name: str, labels: dict[int, str] | None = None, protected: bool = False) -> dict:
    """A book from the runs of its pages. labels: titles by page, for the navigation."""
    if protected:
        raise BookError("the file is protected")
    rows = [{"page": i, **line} for i, p in enumerate(pages, 1) for line in lines(p)]
    if sum(len(re.sub(r"\s", "", r["text"])) for r in rows) < LEAST_CHARACTERS:
        raise BookError("the pages hold no text (scanned)")
    book = new_book(name, name.encode(), title=stem(name))
    margin = {p: min(r["x0"] for r in rows if r["page"] == p) for p in {r["page"] for r in rows}}
    gaps = [last["y"] - r["y"] if last["page"] == r["page"] else None for last, r in zip(rows, rows[1:], strict=False)]
    far = [g is not None and g >= CHAPTER_GAP * LINE_HEIGHT * r["font"] for g, r in zip(gaps, rows[1:], strict=True)]
    groups: list[list[dict]] = []
    for i, r in enumerate(rows):
        gap = gaps[i - 1] if i else None
        bucket = i > 0 and (r["page"] - 1) // PAGES != (rows[i - 1]["page"] - 1) // PAGES
        new = not i or (far[i - 1] if any(far) else bucket)
        if new:
            groups.append([])
        if new or (gap is not None and gap >= PARAGRAPH_GAP * LINE_HEIGHT * r["font"]) or r["x0"] - margin[r["page"]] > INDENT * r["font"]:
            groups[-1].append({"page": r["page"], "lines": []})
        groups[-1][-1]["lines"].append(r["text"])
    for g in groups:
        chapter(book, None, "\n".join(f"<p>{escape_text(joined(p['lines']))}</p>" for p in g), prefix="pdf-ch-")
    starts = [g[0]["page"] for g in groups]
    for page, title in sorted((labels or {}).items()):
        k = starts.index(page) if page in starts else max((i for i, s in enumerate(starts) if s < page), default=0)
        book["nav"].append({"id": f"n{len(book['nav']) + 1}", "parent": None, "title": title, "target": book["chapters"][k]["id"], "anchor": None, "level": 1})
    warn(book, "pdf.flat-nav" if labels else "pdf.no-structure")
    if not any(far) and len(groups) > 1:
        warn(book, "pdf.paged-chapters")
    return book
