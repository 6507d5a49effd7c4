"""ZIP archives of texts: what each entry is, names in old encodings, one nested level, images beside Markdown."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

from quire.model import BookError, failed, warn

READABLE = ("txt", "md", "epub", "docx", "mobi", "azw3", "azw")
UNSUPPORTED = ("pdf", "rar", "7z", "doc", "rtf")
IMAGES = ("jpg", "jpeg", "png", "gif", "svg", "webp", "bmp")
#: An entry that unpacks to more is refused, as a book of its own that failed: a row of a table holds 2 GiB at most.
ENTRY_BYTES = 1 << 30


def extension(path: str) -> str:
    base = path.rpartition("/")[2]
    return base.rpartition(".")[2].lower() if "." in base else ""


def is_junk(path: str) -> bool:
    base = path.rpartition("/")[2]
    return path.startswith("__MACOSX/") or "/__MACOSX/" in path or base in (".DS_Store", "Thumbs.db", "desktop.ini") or base.startswith("._")


def entry_name(info: zipfile.ZipInfo) -> str:
    """The entry's name: UTF-8 if it is that, else GB18030, else Big5."""
    if info.flag_bits & 0x800:
        return info.filename
    raw = info.filename.encode("cp437", "replace")
    for encoding in ("utf-8", "gb18030", "big5"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def opened(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise BookError(f"no ZIP archive: {e}") from e


def loader(z: zipfile.ZipFile, info: zipfile.ZipInfo) -> Callable[[], bytes]:
    def load() -> bytes:
        if info.file_size > ENTRY_BYTES:
            raise BookError("the entry unpacks to too much")
        return z.read(info)

    return load


def classified(data: bytes) -> Iterator[tuple[str, str, Callable[[], bytes]]]:
    """(path, class, how to load the content): book, unsupported, skipped or too deep. Entries of inner archives carry their
    archive's path in front. Nothing but inner archives is unpacked here."""
    z = opened(data)
    for info in z.infolist():
        path = entry_name(info)
        if info.is_dir() or is_junk(path):
            continue
        if extension(path) != "zip":
            yield path, kind(path), loader(z, info)
            continue
        try:
            inner = opened(loader(z, info)())
        except BookError:
            yield path, "skipped", bytes
            continue
        for sub in inner.infolist():
            name = entry_name(sub)
            if not sub.is_dir() and not is_junk(name):
                deep = extension(name) == "zip"
                yield f"{path}/{name}", "too deep" if deep else kind(name), loader(inner, sub)


def kind(path: str) -> str:
    e = extension(path)
    return "book" if e in READABLE else "unsupported" if e in UNSUPPORTED else "skipped"


def beside(path: str, entries: dict[str, Callable[[], bytes]]) -> dict[str, Callable[[], bytes]]:
    """Images in the folder of path, by their names there."""
    folder = path.rpartition("/")[0]
    return {p.rpartition("/")[2]: d for p, d in entries.items() if p.rpartition("/")[0] == folder and extension(p) in IMAGES}


def read_all(data: bytes, name: str, readers: dict, first: bool = False) -> list[dict]:
    """A book for each that the archive holds, by name; one that fails does so on its own. Entries are unpacked one at a
    time, with the images beside them. first: only the first book, with a warning if there are more."""
    from quire.sources import markdown

    entries = list(classified(data))
    content = {p: d for p, _, d in entries}
    books, used = [], set()
    found = sorted(p for p, k, _ in entries if k == "book")
    for path in found[:1] if first else found:
        full = f"{name}/{path}"
        try:
            if extension(path) == "md":
                near = beside(path, content)
                assets = {k: (markdown.mime_of(k), load()) for k, load in near.items()}
                book = markdown.read(content[path](), full, assets)
                if book["resources"]:
                    used |= {f"{path.rpartition('/')[0]}/{k}".lstrip("/") for k in near}
            else:
                book = readers[extension(path)](content[path](), full)
        except Exception as e:  # one member's failure is its own
            book = failed(full, str(e))
        books.append(book)
    if not books:
        return [failed(name, "no book in the archive")]
    for k, code in (("skipped", "zip.skipped"), ("unsupported", "zip.unsupported"), ("too deep", "zip.nested-too-deep")):
        left = [p for p, c, _ in entries if c == k and p not in used]
        if left:
            more = f" ({len(left)} in all)" if len(left) > 5 else ""
            warn(books[0], code, ", ".join(left[:5]) + more)
    if first and len(found) > 1:
        warn(books[0], "zip.multiple-books", str(len(found)))
    return books
