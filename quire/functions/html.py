"""HTML functions over columns, as expressions that Catalyst plans. They read HTML whose dropped elements aren't nested in
their own kind; `markup` has the full state machines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.schema import ALLOWED_TAGS, DROPPED_TAGS

BLOCKS = "p|div|li|h1|h2|h3|h4|h5|h6|blockquote|tr|figcaption|dd|dt"
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}
REFERENCE = r"&(?:#[xX][0-9A-Fa-f]+|#[0-9]+|[A-Za-z]+);"

#: (pattern, replacement) steps that leave a text. Comments and dropped elements may lack their end.
STEPS = (
    (r"(?s)<!--.*?(?:-->|\z)", ""),
    (rf"(?is)<({'|'.join(DROPPED_TAGS)})(?:\s(?:[^>]*[^/>])?)?>.*?(?:</\1\s*>|\z)", ""),
    (r"<[!?][^>]*>", ""),
    (r"(?i)<br(?:\s[^>]*)?/?>", "\n"),
    (rf"(?i)</(?:{BLOCKS})\s*>", "\n"),
    (r"</?[A-Za-z][^>]*>", ""),
)


def decode_reference(r: Column) -> Column:
    """What one reference stands for: a character by number, or one of six by name; any other stays as it is."""
    number = F.when(F.lower(F.substring(r, 3, 1)) == "x", F.conv(F.substring(r, 4, 20), 16, 10)).when(F.substring(r, 2, 1) == "#", F.substring(r, 3, 20))
    n = F.regexp_replace(number, "[^0-9]", "").try_cast("long")
    valid = (n >= 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
    named = F.element_at(F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair]), F.lower(F.regexp_replace(r, "[&;]", "")))
    return F.coalesce(F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")), named, r)


def decode_entities(text: Column) -> Column:
    """Each reference decoded once, so that what it makes isn't decoded again."""
    found = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), 0), decode_reference)
    both = F.zip_with(F.split(text, REFERENCE, -1), found, lambda piece, own: F.concat(piece, F.coalesce(own, F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(both, "")).otherwise(text)


def plain_text(html: Column) -> Column:
    out = html
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by)
    out = F.regexp_replace(decode_entities(out), r"[ \t\u00A0]+", " ")
    return T.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def character_count(html: Column) -> Column:
    """UTF-16 units of the plain text without white space."""
    return T.utf16_length(T.without_space(plain_text(html)))


def tags_in(html: Column) -> Column:
    """Distinct names of opened or closed tags."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    return F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit("</?([A-Za-z][A-Za-z0-9]*)"), 1), F.lower))


def illegal_tags(html: Column) -> Column:
    return F.array_except(tags_in(html), F.array(*[F.lit(t) for t in ALLOWED_TAGS]))


def dropped_tags(html: Column) -> Column:
    return F.array_intersect(tags_in(html), F.array(*[F.lit(t) for t in DROPPED_TAGS]))


def first_heading(html: Column) -> Column:
    """Of the first h1 to h6, the text without tags; null if there is none or it is empty."""
    inner = F.regexp_extract(html, r"(?is)<h[1-6](?:\s[^>]*)?>(.*?)</h[1-6]\s*>", 1)
    return F.nullif(T.trim(F.regexp_replace(inner, r"<[^>]*>", "")), F.lit(""))


def without_readings(html: Column) -> Column:
    """Ruby markup reduced to its base text."""
    out = F.regexp_replace(html, r"(?is)<rp>.*?</rp>", "")
    out = F.regexp_replace(out, r"(?is)<rt>.*?</rt>", "")
    return F.regexp_replace(out, r"(?i)</?ruby(?:\s[^>]*)?>", "")


def has_ruby(html: Column) -> Column:
    return html.rlike(r"(?i)<ruby[\s>]")


def title_is_heading(html: Column, title: Column) -> Column:
    """Whether a chapter's body already opens with its title, readings aside."""
    return F.coalesce(first_heading(without_readings(html)) == T.trim(title), F.lit(False))


def attribute_values(html: Column, tag: str, name: str) -> Column:
    """Values of quoted attributes, in order."""
    return F.regexp_extract_all(html, F.lit(rf'(?i)<{tag}\s(?:[^>]*?\s)?{name}\s*=\s*"([^">]*)"'), 1)


def links(html: Column) -> Column:
    return attribute_values(html, "a", "href")


def images(html: Column) -> Column:
    return attribute_values(html, "img", "src")


def link_class(href: Column) -> Column:
    """external, same (an anchor of the same document), cross (another document), or drop."""
    return F.when(T.trim(href) == "", "drop").when(T.is_external(href), "external").when(href.startswith("#"), "same").otherwise("cross")


def body(html: Column) -> Column:
    inner = F.regexp_extract(html, r"(?is)<body(?:\s[^>]*)?>(.*)</body\s*>", 1)
    return F.when(html.rlike(r"(?is)<body(?:\s[^>]*)?>.*</body\s*>"), inner).otherwise(html)


def ruby(base: Column, reading: Column) -> Column:
    return F.concat(F.lit("<ruby>"), base, F.lit("<rp>(</rp><rt>"), reading, F.lit("</rt><rp>)</rp></ruby>"))


def without_class(html: Column, name: str) -> Column:
    """html with a class name taken out of every class attribute."""
    out = F.regexp_replace(html, rf'(?i)(\sclass="(?:[^">]*\s)?){name}(?:\s+|(?="))', "$1")
    return F.regexp_replace(F.regexp_replace(out, r'(?i)(\sclass="[^">]*?)\s+"', '$1"'), r'(?i)\sclass=""', "")
