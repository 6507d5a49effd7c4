"""Queries over text and markup functions. The test tables hold no CJK text, so letters of theirs are exchanged for some (GLYPHS); the
SQL is written by hand and shares no pattern or table with the functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions import text as T
from quire.operators.ruby import annotated_column
from quire.operators.variants import DEMO, converted_column, effective_scheme, is_japanese, scheme_for
from quire.plans.registry import query, t

LETTERS, GLYPHS = "abcdefghijklmnopqrstuvwxyz", "生れ漢字の々〇カナーヴ見当。は」？国語ん！ヘ豈𠮟ａy"
CJK = f"(SELECT doc_id, translate(lower(left(text, 400)), '{LETTERS}', '{GLYPHS}') AS s FROM documents)"
KANJI = r"\x{3005}\x{3007}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FFFF}"
WS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
TITLES = f"(SELECT conv_id, turn, role || ' ' || turn || '!  ' || translate(lower(left(text, 70)), 'aeiou', '見/の:é') AS title FROM conversations)"


def cjk(spark, sf) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", F.translate(F.lower(F.left("text", F.lit(400))), LETTERS, GLYPHS).alias("s"))


def titles(spark, sf) -> DataFrame:
    end = F.translate(F.lower(F.left("text", F.lit(70))), "aeiou", "見/の:é")
    return t(spark, sf, "conversations").select("conv_id", "turn", F.concat("role", F.lit(" "), "turn", F.lit("!  "), end).alias("title"))


def picked(values, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def sql_picked(values, number: str) -> str:
    rows = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{rows}])[({number} % {len(values)} + 1)::INT]"


# Characters


@query(f"SELECT doc_id, array_to_string(list_transform(string_split(s, ''), lambda c: CASE WHEN ord(c) BETWEEN 12449 AND 12534 THEN chr((ord(c) - 96)::INT) ELSE c END), '') AS hira FROM {CJK}")
def kana_to_hiragana(spark, sf):
    return cjk(spark, sf).select("doc_id", T.hiragana(F.col("s")).alias("hira"))


@query(f"SELECT doc_id, array_to_string(regexp_extract_all(s, '[{KANJI}]+|[^{KANJI}]+'), '|') AS runs, regexp_matches(s, '[{KANJI}]') AS kanji, regexp_matches(regexp_replace(s, '[生漢字々〇見当国語]', '', 'g'), '[{KANJI}]') AS rare FROM {CJK}")
def kanji_runs(spark, sf):
    s = F.col("s")
    return cjk(spark, sf).select("doc_id", F.array_join(T.kanji_runs(s), "|").alias("runs"), T.has_kanji(s).alias("kanji"), T.has_rare_kanji(s, "生漢字々〇見当国語").alias("rare"))


@query(f"SELECT doc_id, (length(s) + length(regexp_replace(s, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))::BIGINT AS units FROM {CJK}")
def utf16_lengths(spark, sf):
    return cjk(spark, sf).select("doc_id", T.utf16_length(F.col("s")).alias("units"))


@query(f"""SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(s, '([。！？；][”’」』）)】》〉";'']*|[.!?](?:[{WS}]+|\\z))', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''), '|') AS pieces FROM {CJK}""")
def sentences_cjk(spark, sf):
    return cjk(spark, sf).select("doc_id", F.array_join(T.sentences(F.col("s")), "|").alias("pieces"))


HEADS = ("第一章", "第十回 起点", "第12節", "番外", "後記 完", "第一章：标题", "第一章开始", "01", " 楔子", "第〇〇卷　上", "终章x", "序章")


@query(f"""SELECT doc_id, line, regexp_matches(line, '^[{WS}]*(第[〇零一二三四五六七八九十百千萬万两兩0-9]+[章回節节卷篇部集]|序章|楔子|引子|尾聲|尾声|後記|后记|番外|终章|終章)([{WS}]|$)') AS heading
FROM (SELECT doc_id, {sql_picked(HEADS, 'doc_id')} || CASE WHEN doc_id % 3 = 0 THEN ' ' || left(text, 9) ELSE '' END AS line FROM documents)""")
def heading_lines(spark, sf):
    d = t(spark, sf, "documents")
    line = F.concat(picked(HEADS, F.col("doc_id")), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.left("text", F.lit(9)))).otherwise(""))
    return d.select("doc_id", line.alias("line")).select("doc_id", "line", T.is_heading(F.col("line")).alias("heading"))


@query("""SELECT o_orderkey, d, CASE WHEN o_orderkey % 5 < 2 THEN left(d, 10) WHEN o_orderkey % 5 = 2 THEN d || '-01-01' END AS iso FROM
(SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN x WHEN 1 THEN x || 'T07:08' WHEN 2 THEN left(x, 4) WHEN 3 THEN 'on ' || x ELSE left(x, 7) END AS d FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS x FROM orders))""")
def dates(spark, sf):
    x, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 5
    d = F.when(k == 0, x).when(k == 1, F.concat(x, F.lit("T07:08"))).when(k == 2, F.left(x, F.lit(4))).when(k == 3, F.concat(F.lit("on "), x)).otherwise(F.left(x, F.lit(7)))
    return t(spark, sf, "orders").select("o_orderkey", d.alias("d")).select("o_orderkey", "d", T.normal_date(F.col("d")).alias("iso"))


# Names and paths


@query(f"SELECT conv_id, turn, regexp_replace(regexp_replace(lower(regexp_replace(title, '^[{WS}]+|[{WS}]+$', '', 'g')), '[{WS}]+', '-', 'g'), '[^\\p{{L}}\\p{{N}}-]', '', 'g') AS slug FROM {TITLES}")
def slugs(spark, sf):
    return titles(spark, sf).select("conv_id", "turn", T.slug(F.col("title")).alias("slug"))


@query(f"""SELECT conv_id, turn, CASE WHEN turn % 9 = 0 THEN 'chapter-' || lpad(turn::VARCHAR, 4, '0') ELSE left(regexp_replace(regexp_replace(translate(regexp_replace(title, '[\\x00-\\x1F]', '', 'g'), '\\/:*?"<>|#%&{{}}', ''), '[{WS}]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), 60) END AS base FROM {TITLES}""")
def file_bases(spark, sf):
    title = F.when(F.col("turn") % 9 == 0, F.lit("?/ .")).otherwise(F.col("title"))
    return titles(spark, sf).select("conv_id", "turn", T.file_base(title, F.col("turn")).alias("base"))


HREFS = ("img/x{}.png", "../img/{}.png", "./a/../b{}.html", "../../up{}.css", "a/./b//c{}")
RESOLVED = ("OPS/text/img/x{}.png", "OPS/img/{}.png", "OPS/text/b{}.html", "up{}.css", "OPS/text/a/b/c{}")


@query(f"SELECT page_id, replace({sql_picked(HREFS, 'page_id')}, '{{}}', page_id::VARCHAR) AS href, replace({sql_picked(RESOLVED, 'page_id')}, '{{}}', page_id::VARCHAR) AS path FROM pages")
def resolved_paths(spark, sf):
    href = F.replace(picked(HREFS, F.col("page_id")), F.lit("{}"), F.col("page_id").cast("string"))
    p = t(spark, sf, "pages").select("page_id", href.alias("href"))
    return p.select("page_id", "href", T.resolve_path(F.lit("OPS/text/c.html"), F.col("href")).alias("path"))


@query("""SELECT page_id, name, CASE page_id % 7 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/png' WHEN 3 THEN 'image/svg+xml' WHEN 4 THEN 'image/webp' ELSE 'application/octet-stream' END AS mime
FROM (SELECT page_id, 'd.e/' || page_id || (['.JPG', '.jpeg', '.Png', '.svg', '.webp', '', '.txt'])[(page_id % 7 + 1)::INT] AS name FROM pages)""")
def mime_types(spark, sf):
    name = F.concat(F.lit("d.e/"), "page_id", picked((".JPG", ".jpeg", ".Png", ".svg", ".webp", "", ".txt"), F.col("page_id")))
    return t(spark, sf, "pages").select("page_id", name.alias("name"), T.mime_by_extension(name).alias("mime"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/bmp' END AS mime FROM pages""")
def image_signatures(spark, sf):
    data = F.unhex(F.concat(picked(("FFD8FFE0", "89504E470D", "47494638", "424D00", "0042"), F.col("page_id")), F.hex(F.encode(F.left("html", F.lit(20)), "UTF-8"))))
    return t(spark, sf, "pages").select("page_id", T.mime_by_content(data).alias("mime"))


@query("""SELECT page_id, regexp_extract(url, '([^/]*?)(?:\\.[^./]*)?$', 1) || (['', '（简）', ''])[(page_id % 3 + 1)::INT] || (['.epub', '.kepub.epub'])[(page_id % 2 + 1)::INT] AS name FROM pages""")
def output_names(spark, sf):
    p = F.col("page_id")
    return t(spark, sf, "pages").select("page_id", T.output_name(F.col("url"), picked(("", "简", None), p), picked(("epub", "kepub"), p)).alias("name"))


@query("""SELECT o_orderkey, size, CASE WHEN size >= 1048576 THEN printf('%.1f MB', size / 1048576) ELSE greatest(1, floor(size / 1024 + 0.5))::BIGINT || ' KB' END AS label
FROM (SELECT o_orderkey, (o_orderkey * o_orderkey * 7 % 5000003)::BIGINT AS size FROM orders)""")
def size_labels(spark, sf):
    size = (F.col("o_orderkey") * F.col("o_orderkey") * 7 % 5000003).cast("long")
    return t(spark, sf, "orders").select("o_orderkey", size.alias("size"), T.size_label(size).alias("label"))


# Markup

RUBY = f"(SELECT doc_id, '<p class=\"x noteref y\">' || replace(replace(s, '。', '<ruby>漢<rp>(</rp><rt>かん' || chr(10) || '</rt><rp>)</rp></RUBY>'), '！', '<a class=\"noteref\" href=\"#n\">1</a>') || '</p>' AS html FROM {CJK})"


def with_ruby(spark, sf) -> DataFrame:
    html = F.replace(F.replace("s", F.lit("。"), F.lit("<ruby>漢<rp>(</rp><rt>かん\n</rt><rp>)</rp></RUBY>")), F.lit("！"), F.lit('<a class="noteref" href="#n">1</a>'))
    return cjk(spark, sf).select("doc_id", F.concat(F.lit('<p class="x noteref y">'), html, F.lit("</p>")).alias("html"))


@query(f"SELECT doc_id, contains(html, '<ruby>') AS marked, replace(replace(replace(html, '<ruby>漢<rp>(</rp><rt>かん' || chr(10) || '</rt><rp>)</rp></RUBY>', '漢'), '<ruby>', ''), '</RUBY>', '') AS html FROM {RUBY}")
def without_readings(spark, sf):
    return with_ruby(spark, sf).select("doc_id", H.has_ruby(F.col("html")).alias("marked"), H.without_readings(F.col("html")).alias("html"))


@query(f"SELECT doc_id, replace(replace(html, 'class=\"x noteref y\"', 'class=\"x y\"'), '<a class=\"noteref\" href', '<a href') AS html FROM {RUBY}")
def without_noteref(spark, sf):
    return with_ruby(spark, sf).select("doc_id", H.without_class(F.col("html"), "noteref").alias("html"))


# Variants and readings

LANGS = ("ja", "JA-jp", "zh-Hant", "en", None, "xja")


@query(f"""SELECT doc_id, coalesce(lower(lang) LIKE 'ja%', false) AS japanese, CASE WHEN lower(lang) LIKE 'ja%' THEN 'none' ELSE 'tw2cn' END AS scheme FROM (SELECT doc_id, {sql_picked(LANGS, 'doc_id')} AS lang FROM documents)""")
def schemes(spark, sf):
    lang = picked(LANGS, F.col("doc_id"))
    return t(spark, sf, "documents").select("doc_id", is_japanese(lang).alias("japanese"), effective_scheme(lang, F.lit("tw2cn")).alias("scheme"))


@query("""SELECT doc_id, direction || '/' || region AS choice, CASE direction || '/' || region WHEN 'to_simplified/none' THEN 't2cn' WHEN 'to_simplified/tw' THEN 'twp2cn' WHEN 'to_simplified/hk' THEN 'hk2cn'
WHEN 'to_traditional/none' THEN 'cn2t' WHEN 'to_traditional/tw' THEN 'cn2twp' WHEN 'to_traditional/hk' THEN 'cn2hk' ELSE 'none' END AS scheme
FROM (SELECT doc_id, (['none', 'to_simplified', 'to_traditional'])[(doc_id % 3 + 1)::INT] AS direction, (['none', 'tw', 'hk', 'sg'])[(doc_id % 4 + 1)::INT] AS region FROM documents)""")
def scheme_choices(spark, sf):
    direction, region = picked(("none", "to_simplified", "to_traditional"), F.col("doc_id")), picked(("none", "tw", "hk", "sg"), F.col("doc_id"))
    return t(spark, sf, "documents").select("doc_id", F.concat_ws("/", direction, region).alias("choice"), scheme_for(direction, region).alias("scheme"))


WORDS, CHANGED = ("網際網路", "滑鼠", "軟體", "<b>軟</b>體", "國書", "<ruby>網<rt>網</rt></ruby>", "網際"), ("互联网", "鼠标", "软件", "<b>软</b>体", "国书", "<ruby>网<rt>網</rt></ruby>", "网際")


def sql_words(words) -> str:
    return f"array_to_string(list_transform(range(0, 6), lambda i: {sql_picked(words, '(doc_id * (i + 1) + i)')}), ' x ')"


@query(f"SELECT doc_id, {sql_words(WORDS)} AS html, {sql_words(CHANGED)} AS converted FROM documents")
def variants(spark, sf):
    words = [picked(WORDS, F.col("doc_id") * (i + 1) + i) for i in range(6)]
    return t(spark, sf, "documents").select("doc_id", F.concat_ws(" x ", *words).alias("html")).select("doc_id", "html", converted_column(F.col("html"), DEMO).alias("converted"))


MORPHEMES = (("生まれ", "ウマレ"), ("見当", "ケントウ"), ("カナ", "カナ"), ("日", None), ("お茶の水", "オチャノミズ"), ("今日は", "コンニチワ"))
MARKED = (
    "<ruby>生<rp>(</rp><rt>う</rt><rp>)</rp></ruby>まれ", "<ruby>見当<rp>(</rp><rt>けんとう</rt><rp>)</rp></ruby>", "カナ", "日",
    "お<ruby>茶<rp>(</rp><rt>ちゃ</rt><rp>)</rp></ruby>の<ruby>水<rp>(</rp><rt>みず</rt><rp>)</rp></ruby>", "<ruby>今日は<rp>(</rp><rt>こんにちわ</rt><rp>)</rp></ruby>",
)


@query(f"SELECT doc_id, {sql_picked([s for s, _ in MORPHEMES], 'doc_id')} AS surface, {sql_picked([r for _, r in MORPHEMES], 'doc_id')} AS reading, {sql_picked(MARKED, 'doc_id')} AS marked FROM documents")
def ruby(spark, sf):
    surface, reading = picked([s for s, _ in MORPHEMES], F.col("doc_id")), picked([r for _, r in MORPHEMES], F.col("doc_id"))
    return t(spark, sf, "documents").select("doc_id", surface.alias("surface"), reading.alias("reading")).select("*", annotated_column(F.col("surface"), F.col("reading")).alias("marked"))
