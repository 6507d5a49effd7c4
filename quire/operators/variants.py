"""Chinese variant conversion with a dictionary that the caller gives: longest match, text between tags piece by
piece, readings (rt) left alone."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMES = ("none", "t2cn", "tw2cn", "twp2cn", "hk2cn", "cn2t", "cn2tw", "cn2twp", "cn2hk")
#: The schemes behind a direction and a region.
BY_CHOICE = {
    ("to_simplified", "none"): "t2cn", ("to_simplified", "tw"): "twp2cn", ("to_simplified", "hk"): "hk2cn",
    ("to_traditional", "none"): "cn2t", ("to_traditional", "tw"): "cn2twp", ("to_traditional", "hk"): "cn2hk",
}
#: What output names say of a scheme.
TAGS = {s: "简体" if s.endswith("2cn") else "繁體" for s in SCHEMES if s != "none"}
#: A few entries to show the operator; real dictionaries are the caller's.
DEMO = {"網際網路": "互联网", "滑鼠": "鼠标", "軟體": "软件", "軟": "软", "網": "网", "國": "国", "書": "书", "體": "体"}
_PARTS = re.compile(r"<[^>]*>|[^<]+|<")


def read_dictionary(lines: Iterable[str]) -> dict[str, str]:
    """A dictionary in the text format of OpenCC: a word, a tab, its forms with spaces between, the first of which counts."""
    rows = (line.rstrip("\n").split("\t") for line in lines if line.strip() and not line.startswith("#"))
    return {r[0]: r[1].split(" ")[0] for r in rows if len(r) > 1 and r[1].strip()}


class Converter:
    """dictionary: one, or several that are used one after the other; in each the longest word counts."""

    def __init__(self, dictionary: dict[str, str] | list[dict[str, str]]):
        steps = [dictionary] if isinstance(dictionary, dict) else dictionary
        self.steps = [(d, max(map(len, d)), {w[0] for w in d}) for d in steps if d]

    def text(self, text: str) -> str:
        for words, longest, firsts in self.steps:
            out, at = [], 0
            while at < len(text):
                size = 1
                if text[at] in firsts:
                    size = next((n for n in range(min(longest, len(text) - at), 0, -1) if text[at : at + n] in words), 1)
                word = text[at : at + size]
                out.append(words.get(word, word))
                at += size
            text = "".join(out)
        return text

    def html(self, html: str) -> str:
        out, reading = [], 0
        for m in _PARTS.finditer(html):
            part = m[0]
            if part[0] == "<":
                if re.match(r"<rt[\s>]", part, re.I):
                    reading += 1
                elif re.match(r"</rt\s*>", part, re.I):
                    reading = max(0, reading - 1)
                out.append(part)
            else:
                out.append(part if reading else self.text(part))
        return "".join(out)


def is_japanese(language: Column) -> Column:
    return F.coalesce(F.lower(language).startswith("ja"), F.lit(False))


def effective_scheme(language: Column, scheme: Column) -> Column:
    """Japanese books are never converted: their kanji would change."""
    return F.when(is_japanese(language), "none").otherwise(scheme)


def scheme_for(direction: Column, region: Column) -> Column:
    out = F.lit("none")
    for (d, r), s in BY_CHOICE.items():
        out = F.when((direction == d) & (region == r), s).otherwise(out)
    return out


def converted_column(html: Column, dictionary: dict[str, str]) -> Column:
    def convert(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = Converter(dictionary)
        for s in it:
            yield s.map(lambda x: None if x is None else c.html(x))

    convert.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(convert, "string")(html)


def converted(books: DataFrame, scheme: str, dictionaries: dict[str, dict[str, str] | list[dict[str, str]]]) -> DataFrame:
    """books (nested rows of plans.conversion) with titles, people, descriptions, chapters, notes and navigation
    converted; the language tag stays. Unknown schemes are errors; `none` leaves the plan as it is."""
    if scheme not in SCHEMES:
        raise ValueError(f"scheme {scheme!r} isn't known")
    if scheme == "none":
        return books
    if scheme not in dictionaries:
        raise ValueError(f"no dictionary for {scheme!r}")
    from quire.plans.conversion import mapped

    c = Converter(dictionaries[scheme])

    def change(book: dict) -> dict:
        if (book["meta"]["language"] or "").lower().startswith("ja"):
            return book
        fix = lambda x: c.text(x) if x else x
        meta = book["meta"] | {k: fix(book["meta"][k]) for k in ("title", "author", "publisher", "description")}
        return book | {
            "meta": meta, "chapters": [x | {"title": fix(x["title"]), "html": c.html(x["html"])} for x in book["chapters"]],
            "notes": [x | {"html": c.html(x["html"])} for x in book["notes"]], "nav": [x | {"title": fix(x["title"])} for x in book["nav"]],
        }

    return mapped(books, change)
