"""Text functions over columns. White space is that of ECMAScript unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: For the inside of a character class in Java; the names in _RE2 hold the same for RE2.
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACE_RE2 = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

#: Code points that a wrong guess of a Chinese encoding tends to produce.
BAD = r"\x00-\x08\x0B\x0C\x0E-\x1F\u2500-\u25FF\u3100-\u312F\u31A0-\u31BF\uE000-\uF8FF\uFFFD"
BAD_RE2 = r"\x00-\x08\x0B\x0C\x0E-\x1F\x{2500}-\x{25FF}\x{3100}-\x{312F}\x{31A0}-\x{31BF}\x{E000}-\x{F8FF}\x{FFFD}"

#: A chapter's heading line.
HEADING = "第[〇零一二三四五六七八九十百千萬万两兩0-9]+[章回節节卷篇部集]|序章|楔子|引子|尾聲|尾声|後記|后记|番外|终章|終章"

KANJI = r"\u3005\u3007\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{2FFFF}"

#: Sentence ends, and the closers that stay with them.
ENDERS = "。！？；"
CLOSERS = "”’」』）)】》〉\";'"

MIME_BY_EXTENSION = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif",
    "svg": "image/svg+xml", "webp": "image/webp", "bmp": "image/bmp",
}
SIGNATURES = {"FFD8FF": "image/jpeg", "89504E47": "image/png", "474946": "image/gif", "424D": "image/bmp"}


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def is_heading(line: Column) -> Column:
    return line.rlike(f"^[{SPACE}]*(?:{HEADING})(?:[{SPACE}]|$)")


def bad_score(text: Column) -> Column:
    """The share of code points that speak against an encoding; 1 for an empty text."""
    kept = F.length(F.regexp_replace(text, f"[{BAD}]", ""))
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise((F.length(text) - kept) / F.length(text))


def escape_text(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attribute(text: Column) -> Column:
    """Also escapes >, so that splitting at tags finds an attribute's end."""
    return F.replace(escape_text(text), F.lit('"'), F.lit("&quot;"))


def hiragana(text: Column) -> Column:
    """Katakana to hiragana; the long-vowel mark stays."""
    kata = "".join(map(chr, range(0x30A1, 0x30F7)))
    return F.translate(text, kata, "".join(chr(ord(c) - 0x60) for c in kata))


def has_kanji(text: Column) -> Column:
    return text.rlike(f"[{KANJI}]")


def kanji_runs(text: Column) -> Column:
    """Alternating runs of kanji and of anything else."""
    return F.regexp_extract_all(text, F.lit(f"[{KANJI}]+|[^{KANJI}]+"), 0)


def has_rare_kanji(text: Column, common: str) -> Column:
    return F.translate(text, common, "").rlike(f"[{KANJI}]") if common else has_kanji(text)


def sentences(text: Column) -> Column:
    """Pieces that join to the text: cut behind CJK ends with their closers, and behind . ! ? with the white
    space after them."""
    cut = F.regexp_replace(text, f"([{ENDERS}][{CLOSERS}]*|[.!?](?:[{SPACE}]+|\\z))", "$1\u0001")
    return F.filter(F.split(cut, "\u0001"), lambda x: x != "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"\.[^.]*$", "")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*/)", 1)


def resolve_path(base: Column, href: Column) -> Column:
    """href beside base, with . and .. taken out."""
    parts = F.split(F.concat(directory(base), href), "/")
    return F.array_join(
        F.aggregate(
            parts, F.array().cast("array<string>"),
            lambda out, p: F.when(p.isin("", "."), out).when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, p)),
        ),
        "/",
    )


def is_external(href: Column) -> Column:
    return href.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)")


def mime_by_extension(path: Column) -> Column:
    out = F.lit("application/octet-stream")
    for ext, mime in MIME_BY_EXTENSION.items():
        out = F.when(extension(path) == ext, mime).otherwise(out)
    return out


def mime_by_content(data: Column) -> Column:
    out = F.lit(None).cast("string")
    for magic, mime in SIGNATURES.items():
        out = F.when(F.substring(F.hex(data), 1, len(magic)) == magic, mime).otherwise(out)
    return out


def data_uri(mime: Column, data: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(data), r"[\r\n]", ""))


def normal_date(text: Column) -> Column:
    """YYYY-MM-DD at the start as it is, a year alone as its first day, else null."""
    day, year = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1), F.regexp_extract(text, r"^(\d{4})$", 1)
    return F.when(day != "", day).when(year != "", F.concat(year, F.lit("-01-01")))


def slug(title: Column) -> Column:
    """Lower case; white space becomes -, and only letters, digits and - stay."""
    return F.regexp_replace(F.regexp_replace(F.lower(trim(title)), f"[{SPACE}]+", "-"), r"[^\p{L}\p{N}-]", "")


def file_base(title: Column, number: Column) -> Column:
    """A safe file name of 60 characters at most, else the chapter's number."""
    safe = F.regexp_replace(F.regexp_replace(title, r'[\\/:*?"<>|#%&{}\x00-\x1F]', ""), f"[{SPACE}]+", "-")
    safe = F.left(F.regexp_replace(safe, r"^[-.]+|[-.]+$", ""), F.lit(60))
    return F.coalesce(F.nullif(safe, F.lit("")), F.concat(F.lit("chapter-"), F.lpad(number.cast("string"), 4, "0")))


def output_name(path: Column, tag: Column, fmt: Column) -> Column:
    tagged = F.when(F.coalesce(tag, F.lit("")) == "", "").otherwise(F.concat(F.lit("（"), tag, F.lit("）")))
    return F.concat(stem(path), tagged, F.lit("."), F.when(fmt == "kepub", "kepub.epub").otherwise(fmt))


def size_label(size: Column) -> Column:
    """Kilobytes, or megabytes with one decimal; of two as near (1.25 MB), the even one."""
    return F.when(size >= 1 << 20, F.format_string("%.1f MB", F.bround(size / (1 << 20), 1))).otherwise(F.format_string("%d KB", F.greatest(F.lit(1), F.round(size / 1024)).cast("int")))
