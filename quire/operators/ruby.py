"""Japanese reading marks: readings of morphemes, from a tokenizer that the caller gives, as ruby over kanji."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.markup import escape_text

KANJI = "\u3005\u3007\u3400-\u9fff\uf900-\ufaff\U00020000-\U0002ffff"
_RUN = re.compile(f"[{KANJI}]+|[^{KANJI}]+")
_HAS = re.compile(f"[{KANJI}]")
_PARTS = re.compile(r"<[^>]*>|[^<]+|<")
_TO_HIRAGANA = {c: c - 0x60 for c in range(0x30A1, 0x30F7)}

Tokenizer = Callable[[str], Iterable[tuple[str, str | None]]]


def hiragana(text: str) -> str:
    return text.translate(_TO_HIRAGANA)


def mark(base: str, reading: str) -> str:
    return f"<ruby>{base}<rp>(</rp><rt>{escape_text(reading)}</rt><rp>)</rp></ruby>"


def aligned(surface: str, reading: str) -> list[tuple[str, str | None]] | None:
    """Runs of the surface with the reading of each kanji run; None if the kana between don't fit."""
    runs = _RUN.findall(surface)
    pattern = "".join("(.+?)" if _HAS.match(r) else re.escape(hiragana(r)) for r in runs)
    m = re.fullmatch(pattern, hiragana(reading), re.S)
    if not m:
        return None
    groups = iter(m.groups())
    return [(r, next(groups) if _HAS.match(r) else None) for r in runs]


def annotated(surface: str, reading: str | None, common: frozenset[str] | None = None) -> str:
    """One morpheme. With `common`, runs of common kanji only stay bare; a reading that doesn't fit goes over the
    whole morpheme."""
    if not reading or not _HAS.search(surface):
        return surface
    runs = aligned(surface, reading)
    if runs is None:
        return mark(surface, hiragana(reading))
    return "".join(r if y is None or (common is not None and set(r) <= common) else mark(r, y) for r, y in runs)


def annotate_html(html: str, tokenizer: Tokenizer, common: frozenset[str] | None = None) -> str:
    """Text with kanji outside of ruby elements is annotated; all else stays as it is."""
    out, inside = [], 0
    for m in _PARTS.finditer(html):
        part = m[0]
        if part[0] == "<":
            if re.match(r"<ruby[\s>]", part, re.I):
                inside += 1
            elif re.match(r"</ruby\s*>", part, re.I):
                inside = max(0, inside - 1)
            out.append(part)
        elif inside or not _HAS.search(part):
            out.append(part)
        else:
            out += [annotated(s, r, common) for s, r in tokenizer(part)]
    return "".join(out)


def annotated_column(surface: Column, reading: Column) -> Column:
    def mark_all(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for s, r in it:
            yield pd.Series([None if x is None else annotated(x, y) for x, y in zip(s, r, strict=True)], dtype=object)

    mark_all.__annotations__ = {"it": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(mark_all, "string")(surface, reading)


def with_readings(books: DataFrame, load: Callable[[], Tokenizer], common: frozenset[str] | None = None) -> DataFrame:
    """Chapters and notes of Japanese books (nested rows of plans.conversion) annotated. load makes the tokenizer,
    once for each Python worker and task; if that fails, books get a warning and stay as they are."""
    from quire.plans.conversion import mapped

    def prepare():
        try:
            tokenizer = load()
        except Exception:
            return lambda book: book | {"warnings": [*book["warnings"], {"code": "ruby.unavailable", "detail": None}]}

        def change(book: dict) -> dict:
            if not (book["meta"]["language"] or "").lower().startswith("ja"):
                return book
            fix = lambda rows: [x | {"html": annotate_html(x["html"], tokenizer, common)} for x in rows]
            return book | {"chapters": fix(book["chapters"]), "notes": fix(book["notes"])}

        return change

    return mapped(books, prepare=prepare)
