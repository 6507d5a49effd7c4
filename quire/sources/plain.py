"""Plain texts: encodings and chapters."""

from __future__ import annotations

import re

from quire.functions import text as T
from quire.functions.markup import JS_SPACE, escape_text
from quire.model import BookError, chapter, new_book, stem, warn

_HEADING = re.compile(f"(?:{T.HEADING})(?:[{re.escape(JS_SPACE)}]|$)")
_BAD = re.compile(f"[{T.BAD}]")
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def bad_score(text: str) -> float:
    return len(_BAD.findall(text)) / len(text) if text else 1.0


def decoded(data: bytes) -> tuple[str, str, bool]:
    """Text, encoding, and whether the encoding is a guess against all signs."""
    for mark, encoding in MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(encoding, "replace"), encoding, False
    found = {}
    for encoding in ("utf-8", "gb18030", "big5"):
        try:
            found[encoding] = data.decode(encoding)
        except UnicodeDecodeError:
            continue
        if encoding == "utf-8":
            return found[encoding], encoding, False
    if not found:
        return data.decode("gb18030", "replace"), "gb18030", True
    best = min(found, key=lambda e: (bad_score(found[e]), e != "gb18030"))
    return found[best], best, False


def read(data: bytes, name: str) -> dict:
    if not data:
        raise BookError("the file is empty")
    text, encoding, guessed = decoded(data)
    book = new_book(name, data, title=stem(name), language="zh-Hant" if encoding == "big5" else "zh-Hans")
    if guessed:
        warn(book, "txt.encoding-fallback")
    lines = [line.strip(JS_SPACE) for line in re.sub(r"\r\n?", "\n", text).split("\n")]
    title, held, seen = None, [], False

    def close() -> None:
        if title is not None or held:
            chapter(book, title, "\n".join(f"<p>{escape_text(x)}</p>" for x in held))

    for line in lines:
        if _HEADING.match(line):
            close()
            title, held, seen = line, [], True
        elif line:
            held.append(line)
    close()
    if not book["chapters"]:
        chapter(book, None, "")
    if not seen:
        warn(book, "txt.no-chapters")
    return book
