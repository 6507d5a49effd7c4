"""Queries that write and read files of each format, a conversation a book, a turn a chapter. The SQL says, from the rows alone, what
must be in the files or come back."""

from __future__ import annotations

import zipfile
from collections.abc import Callable
from io import BytesIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.markup import escape_text
from quire.model import BOOK
from quire.plans import conversion as C
from quire.plans import samples
from quire.plans.registry import query, t

FILES = "path string, content binary"
LETTERS, GLYPHS = "abcdefghijklmnopqrstuvwxyz", "的一是不了人我在有他中大上和到大地出自以可成家年同生"
PNG = b"\x89PNG\r\n\x1a\nimage"
#: Words of a turn: letters, digits and single spaces only.
PLAIN = "trim(regexp_replace(regexp_replace(left(text, 160), '[^A-Za-z ]', ' ', 'g'), ' +', ' ', 'g'))"
ROWS = f"(SELECT conv_id, turn, role, {PLAIN} AS p, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS ord FROM conversations)"


def turns(spark, sf) -> DataFrame:
    """conv_id, turns: an array of (turn, role, p) in order."""
    p = F.trim(F.regexp_replace(F.regexp_replace(F.left("text", F.lit(160)), "[^A-Za-z ]", " "), " +", " "))
    rows = t(spark, sf, "conversations").select("conv_id", "turn", "role", p.alias("p"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "p"))).alias("turns"))


def made(rows: DataFrame, make: Callable[[dict], dict]) -> DataFrame:
    """FILES of rows."""
    schema = C.arrow_schema(FILES)
    return rows.mapInArrow(lambda it: C._rows(it, schema, lambda r: [make(r)]), FILES)


def read_back(files: DataFrame) -> DataFrame:
    """conv_id and the nested columns of books, from files named by it."""
    return C.parsed_files(files).withColumn("conv_id", F.regexp_extract("src_path", r"(\d+)\.\w+$", 1).cast("long"))


def chapters(books: DataFrame, *more) -> DataFrame:
    own = books.select("conv_id", *more, F.posexplode("chapters").alias("ord", "c"))
    return own.select("conv_id", "ord", F.col("c.title").alias("title"), F.col("c.level").alias("level"), F.col("c.html").alias("html"), *[c for c in own.columns if c not in ("conv_id", "ord", "c")])


# Texts

ENCODED = f"(SELECT *, translate(lower(p), '{LETTERS}', '{GLYPHS}') || '，。' AS g FROM {ROWS})"


def text_file(r: dict) -> dict:
    end = ("\r\n", "\n", "\r")[r["conv_id"] % 3]
    lines = [x for row in r["turns"] for x in (f" 第{row['turn'] + 1}章 {row['role']}", "", f"  {row['p'].lower().translate(str.maketrans(LETTERS, GLYPHS))}，。 ")]
    text = end.join(lines)
    marks = {1: b"\xef\xbb\xbf", 2: b"\xff\xfe", 3: b"\xfe\xff"}
    encoding = ("utf-8", "utf-8", "utf-16-le", "utf-16-be", "gb18030", "big5")[r["conv_id"] % 6]
    return {"path": f"{r['conv_id']}.txt", "content": marks.get(r["conv_id"] % 6, b"") + text.encode(encoding)}


@query(f"SELECT conv_id, ord, '第' || (turn + 1) || '章 ' || role AS title, 1 AS level, '<p>' || g || '</p>' AS html, CASE WHEN conv_id % 6 = 5 THEN 'zh-Hant' ELSE 'zh-Hans' END AS language FROM {ENCODED}")
def texts_read(spark, sf):
    """Texts in six encodings and three kinds of line ends."""
    return chapters(read_back(made(turns(spark, sf), text_file)), F.col("meta.language").alias("language"))


@query(f"SELECT conv_id, string_agg(role || ' ' || turn || chr(10) || chr(10) || p, chr(10) || chr(10) ORDER BY turn) AS txt FROM {ROWS} GROUP BY 1")
def text_files(spark, sf):
    out = C.written(plain_books(spark, sf), C.Options("txt"))
    text = F.decode(F.substring("content", 4, 100_000_000), "UTF-8")
    return out.select(F.regexp_extract("name", r"(\d+)\.txt$", 1).cast("long").alias("conv_id"), text.alias("txt"))


def plain_books(spark, sf, language: str = "en") -> DataFrame:
    """BOOK rows: a paragraph, a link to the next chapter, a picture in each third chapter, a note in the first."""
    schema = C.arrow_schema(BOOK)

    def make(r: dict) -> list[dict]:
        from quire.model import chapter, nav_from_levels, new_book

        book = new_book(f"{r['conv_id']}.txt", title=f"Book {r['conv_id']}", language=language)
        for x in r["turns"]:
            chapter(book, f"{x['role']} {x['turn']}", f"<p>{escape_text(x['p'])}</p>", 1 if x["turn"] % 3 == 0 else 2)
        nav_from_levels(book)
        return [book]

    return turns(spark, sf).mapInArrow(lambda it: C._rows(it, schema, make), BOOK)


# Markdown

HASHES = "CASE WHEN turn % 3 = 0 THEN 1 WHEN turn % 3 = 1 THEN 2 ELSE 3 END"


def markdown_file(r: dict) -> dict:
    parts = [] if r["conv_id"] % 2 else ["﻿", "", "  "]
    for x in r["turns"]:
        parts += [f"{'#' * (x['turn'] % 3 + 1 if x['turn'] % 3 < 2 else 4)} {x['role']} **{x['turn']}** ##", "", f"{x['p']} **bold** *it* `a<b`", f"[l](#{x['role']}-{x['turn'] + 1}) x & y", "",
                  "- one", "- two", "  more", "", "1. first", "", "> quoted", "", "***", "", "```", "# no <heading>", "```", "", f"![alt](p{x['turn']}.png)z", ""]
    return {"path": f"{r['conv_id']}.md", "content": "\n".join(parts).encode()}


@query(f"""SELECT a.conv_id, a.ord, a.role || ' ' || a.turn AS title, {HASHES.replace('turn', 'a.turn')}::INT AS level,
'<p>' || a.p || ' <strong>bold</strong> <em>it</em> <code>a&lt;b</code> <a href="#' || coalesce('ch' || (b.ord + 1), a.role || '-' || (a.turn + 1)) || '">l</a> x &amp; y</p>' || chr(10) || '<ul><li>one</li><li>two more</li></ul>' || chr(10)
|| '<ol><li>first</li></ol>' || chr(10) || '<blockquote><p>quoted</p></blockquote>' || chr(10) || '<hr />' || chr(10) || '<pre><code># no &lt;heading&gt;</code></pre>' || chr(10) || '<p>z</p>' AS html,
(SELECT count(*) FROM {ROWS} n WHERE n.conv_id = a.conv_id)::INT AS unresolved
FROM {ROWS} a LEFT JOIN {ROWS} b ON b.conv_id = a.conv_id AND b.role = a.role AND b.turn = a.turn + 1""")
def markdown_read(spark, sf):
    """Markdown: sections, blocks, inline marks, links to headings, pictures that aren't there."""
    books = read_back(made(turns(spark, sf), markdown_file))
    return chapters(books, F.size(F.filter("warnings", lambda w: w["code"] == "md.image-unresolved")).alias("unresolved"))


# Word documents


def docx(r: dict) -> dict:
    own = [(f"{x['role']} {x['turn']}", x["turn"] % 3 + 1, [x["p"], "x & y"]) for x in r["turns"]]
    return {"path": f"{r['conv_id']}.docx", "content": samples.docx_file(f"Book {r['conv_id']}", "A & B", own, [f"note {r['conv_id']}"])}


@query(f"""SELECT conv_id, ord, role || ' ' || turn AS title, (turn % 3 + 1)::INT AS level, '<p><strong>' || p || '</strong>' || CASE WHEN ord = 0 THEN '<a class="noteref" href="#footnote-1">1</a>' ELSE '' END
|| '</p>' || chr(10) || '<p>x &amp; y</p>' AS html, 'Book ' || conv_id AS book, 'A & B' AS author, '<p>note ' || conv_id || '</p>' AS note FROM {ROWS}""")
def word_documents_read(spark, sf):
    books = read_back(made(turns(spark, sf), docx))
    return chapters(books, F.col("meta.title").alias("book"), F.col("meta.author").alias("author"), F.get("notes", F.lit(0))["html"].alias("note"))


# Kindle


@query(f"""SELECT conv_id, ord, role || ' ' || turn AS title, CASE WHEN turn % 3 = 0 THEN 1 ELSE 2 END::INT AS level, '<a id="c' || (ord + 1) || '"></a><p>' || p || '</p>' AS html,
'ja' AS language, 'Book ' || conv_id AS book, count(*) OVER (PARTITION BY conv_id)::INT AS entries FROM {ROWS}""")
def mobi_written_and_read(spark, sf):
    files = C.written(plain_books(spark, sf, "ja"), C.Options("mobi")).select(F.col("name").alias("path"), "content")
    return chapters(read_back(files), F.col("meta.language").alias("language"), F.col("meta.title").alias("book"), F.size("nav").alias("entries"))


def kf8(r: dict) -> dict:
    html = lambda x, last: f'<h1 aid="a{x["turn"]}">{x["role"]} {x["turn"]}</h1><p>{x["p"]}<a href="kindle:pos:fid:{0 if last else 1:04}:off:0000000000">n</a><img src="kindle:embed:0001?mime=image/png" alt="i"/></p>'
    own = [(f"{x['role']} {x['turn']}", html(x, len(r["turns"]) == 1), 0 if x["turn"] % 3 == 0 else 1) for x in r["turns"]]
    return {"path": f"{r['conv_id']}.azw3", "content": samples.kf8_file(f"Book {r['conv_id']}", own, PNG, f"B{r['conv_id']}", 0x0411)}


@query(f"""SELECT conv_id, ord, role || ' ' || turn AS title, 1 AS level, '<h1 id="aid-a' || turn || '">' || role || ' ' || turn || '</h1><p>' || p || '<a href="#c' || CASE WHEN count(*) OVER w = 1 THEN 1 ELSE 2 END
|| '">n</a><img src="images/img001.png" alt="i" /></p>' AS html, 'ja' AS language, 'urn:mobi:asin:B' || conv_id AS identifier, 'img001' AS cover,
string_agg(role || ' ' || turn, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS contents FROM {ROWS} WINDOW w AS (PARTITION BY conv_id)""")
def azw3_read(spark, sf):
    """KF8: compressed records, skeletons and fragments, positions, embedded pictures, contents, metadata."""
    books = read_back(made(turns(spark, sf), kf8))
    contents = F.array_join(F.transform("nav", lambda n: n["title"]), "|")
    return chapters(books, F.col("meta.language").alias("language"), F.col("meta.identifier").alias("identifier"), "cover", contents.alias("contents"))


# Archives


def archive(r: dict) -> dict:
    i, text = r["conv_id"], f"第一章 x\n{r['turns'][0]['p']}".encode()
    inner = samples.zip_file([("deep.txt", text), ("deeper.zip", samples.zip_file([("a.txt", b"x")])), ("._junk.txt", b"x")])
    entries = [("z.txt", text), ("m/b.md", b"# T\n![i](p.png)"), ("m/p.png", PNG), ("a/" + "书.txt", text), ("in.zip", inner), ("x.pdf", b"x"), ("y.exe", b"x"), ("__MACOSX/._z.txt", b"x"), (".DS_Store", b"x")]
    return {"path": f"{i}.zip", "content": samples.zip_file(entries if i % 3 else entries[5:])}


MEMBERS = "(VALUES ('a/书.txt', 'zip.nested-too-deep,zip.skipped,zip.unsupported', 0), ('in.zip/deep.txt', '', 0), ('m/b.md', '', 1), ('z.txt', '', 0)) v(path, warnings, resources)"


@query(f"""SELECT conv_id, conv_id || '.zip/' || path AS src_path, warnings, resources::INT AS resources, NULL::VARCHAR AS failure FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 3 <> 0), {MEMBERS}
UNION ALL SELECT DISTINCT conv_id, conv_id || '.zip', '', 0, 'no book in the archive' FROM conversations WHERE conv_id % 3 = 0""")
def archives_read(spark, sf):
    """Archives: nested ones, pictures beside a text, what isn't a book, what nothing can read."""
    books = C.parsed_files(made(turns(spark, sf), archive))
    codes = F.array_join(F.array_sort(F.transform("warnings", lambda w: w["code"])), ",")
    return books.select(F.regexp_extract("src_path", r"^(\d+)", 1).cast("long").alias("conv_id"), "src_path", codes.alias("warnings"), F.size("resources").alias("resources"), "failure")


@query("""SELECT conv_id, conv_id || '.zip' || CASE WHEN conv_id % 3 <> 0 THEN '/a/书.txt' ELSE '' END AS src_path, conv_id % 3 <> 0 AS more FROM (SELECT DISTINCT conv_id FROM conversations)""")
def first_books_of_archives(spark, sf):
    books = C.parsed_files(made(turns(spark, sf), archive), first=True)
    more = F.exists("warnings", lambda w: (w["code"] == "zip.multiple-books") & (w["detail"] == "4"))
    return books.select(F.regexp_extract("src_path", r"^(\d+)", 1).cast("long").alias("conv_id"), "src_path", more.alias("more"))


@query("""SELECT conv_id, 'BookError: ' || (['the file is empty', 'no Word document', 'no Kindle file', 'files of type pdf can''t be read'])[conv_id % 4 + 1] AS failure FROM (SELECT DISTINCT conv_id FROM conversations)""")
def files_that_fail(spark, sf):
    """Files that can't be read are rows."""
    ext, data = ("txt", "docx", "azw3", "pdf"), (b"", b"no", b"x" * 200, b"%PDF")
    files = made(turns(spark, sf), lambda r: {"path": f"{r['conv_id']}.{ext[r['conv_id'] % 4]}", "content": data[r["conv_id"] % 4]})
    return read_back(files).select("conv_id", "failure")


# EPUB, KEPUB, printable HTML


def zip_names(files: DataFrame, suffix: str = "") -> DataFrame:
    """name of the file, entry, text of all entries of ZIP files (name, content)."""
    kind = "name string, entry string, text string"
    schema = C.arrow_schema(kind)

    def entries(r: dict) -> list[dict]:
        with zipfile.ZipFile(BytesIO(r["content"])) as z:
            return [{"name": r["name"], "entry": n, "text": z.read(n).decode()} for n in z.namelist() if n.endswith(suffix)]

    return files.select("name", "content").mapInArrow(lambda it: C._rows(it, schema, entries), kind)


@query(f"""SELECT conv_id, role || '-' || turn || '.xhtml' AS entry FROM {ROWS} UNION ALL
SELECT conv_id, entry FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES ('mimetype'), ('META-INF/container.xml'), ('content.opf'), ('nav.xhtml'), ('toc.ncx'), ('style.css')) v(entry)""")
def epub_entries(spark, sf):
    found = zip_names(C.written(plain_books(spark, sf), C.Options("epub")))
    return found.select(F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("conv_id"), "entry")


@query(f"""SELECT conv_id, count(*) AS points, string_agg(role || ' ' || turn, '|' ORDER BY turn) AS labels, '目次' AS heading, 'rtl' AS direction FROM {ROWS} GROUP BY 1""")
def epub_navigation(spark, sf):
    """The contents of vertical Japanese books, in both forms."""
    books = C.in_mode(plain_books(spark, sf, "ja"), "vertical-rl")
    found = zip_names(C.written(books, C.Options("epub"))).withColumn("conv_id", F.regexp_extract("name", r"(\d+)", 1).cast("long"))
    by = found.groupBy("conv_id").pivot("entry", ["toc.ncx", "nav.xhtml", "content.opf"]).agg(F.first("text"))
    labels = F.slice(F.regexp_extract_all(F.col("`toc.ncx`"), F.lit("<text>([^<]*)</text>"), 1), 2, 100_000)
    points = F.size(F.regexp_extract_all(F.col("`toc.ncx`"), F.lit("playOrder="), 0)).cast("long")
    return by.select(
        "conv_id", points.alias("points"), F.array_join(labels, "|").alias("labels"), F.regexp_extract(F.col("`nav.xhtml`"), "<h1>([^<]*)</h1>", 1).alias("heading"),
        F.regexp_extract(F.col("`content.opf`"), 'page-progression-direction="([^"]*)"', 1).alias("direction"),
    )


SENTENCES = "list_filter(string_split(regexp_replace(x, '([.!?](?:\\s+|$))', '\\1' || chr(1), 'g'), chr(1)), lambda z: trim(z) <> '')"


@query(f"""WITH s AS (SELECT conv_id, turn, role, 'A b. ' || p || '! C' AS x FROM {ROWS}), u AS (SELECT conv_id, role || ' ' || turn AS chapter, unnest({SENTENCES}) AS text, generate_subscripts({SENTENCES}, 1) AS k FROM s)
SELECT conv_id, chapter, 'kobo.2.' || k AS id, text FROM u UNION ALL SELECT conv_id, role || ' ' || turn, 'kobo.1.1', role || ' ' || turn FROM s""")
def kepub_spans(spark, sf):
    """Sentences of KEPUB documents: a number for each paragraph, and for each sentence in it."""
    books = plain_books(spark, sf).withColumn("chapters", F.transform("chapters", lambda c: c.withField("html", F.regexp_replace(c["html"], "<p>(.*)</p>", "<p>A b. $1! C</p>"))))
    found = zip_names(C.written(books, C.Options("kepub")), ".xhtml").where("entry <> 'nav.xhtml'")
    span = r'<span class="koboSpan" id="([^"]*)">([^<]*)</span>'
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(span), 1).alias("id"), F.regexp_extract_all("text", F.lit(span), 2).alias("text"))
    own = found.select(F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("conv_id"), F.regexp_extract("text", "<title>([^<]*)</title>", 1).alias("chapter"), F.explode(pairs).alias("x"))
    return own.select("conv_id", "chapter", F.col("x.id").alias("id"), F.col("x.text").alias("text"))


@query(f"""SELECT conv_id, string_agg('<section id="c' || (ord + 1) || '"><h' || CASE WHEN turn % 3 = 0 THEN 1 ELSE 2 END || '>' || role || ' ' || turn || '</h' || CASE WHEN turn % 3 = 0 THEN 1 ELSE 2 END || '><p>' || p || '</p></section>', '' ORDER BY turn) AS body,
count(*) AS entries, 'Book ' || conv_id AS title FROM {ROWS} GROUP BY conv_id""")
def printable_files(spark, sf):
    out = C.written(plain_books(spark, sf), C.Options("html")).withColumn("text", F.decode("content", "UTF-8"))
    return out.select(
        F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("conv_id"), F.regexp_extract("text", "(?s)(<section.*</section>)", 1).alias("body"),
        F.size(F.regexp_extract_all("text", F.lit("<li><a href="), 0)).cast("long").alias("entries"), F.regexp_extract("text", "<title>([^<]*)</title>", 1).alias("title"),
    )


# Conversions

NOTES = "CASE WHEN conv_id % 2 = 0 THEN 'Characters weren''t converted: the book is Japanese.|Reading marks weren''t made: this format can''t hold them.|The vertical writing mode isn''t kept by this format.' ELSE 'The vertical writing mode isn''t kept by this format.' END"


@query(f"SELECT conv_id, conv_id || CASE WHEN conv_id % 2 = 0 THEN '' ELSE '（繁體）' END || '.mobi' AS name, {NOTES} AS notes FROM (SELECT DISTINCT conv_id FROM conversations)")
def conversion_notes(spark, sf):
    """What is told of conversions that can't keep all: half of the books are Japanese."""
    even = F.regexp_extract("src_path", r"(\d+)", 1).cast("long") % 2 == 0
    books = plain_books(spark, sf, "en").withColumn("meta", F.col("meta").withField("language", F.when(even, "ja").otherwise("zh-Hans")))
    out = C.convert(books, C.Options("mobi", scheme="cn2t", writing_mode="vertical-rl", tag=None, readings="all"), {"cn2t": {"国": "國"}})
    return out.select(F.regexp_extract("name", r"^(\d+)", 1).cast("long").alias("conv_id"), "name", F.array_join("notes", "|").alias("notes"))


@query(f"""SELECT conv_id, ord, replace(replace(p, 'th', '<ruby>国<rp>(</rp><rt>くに</rt><rp>)</rp></ruby>'), 'an', 'x国') AS html FROM (SELECT conv_id, ord, p FROM {ROWS})""")
def reading_marks(spark, sf):
    """Reading marks in books: words before ruby that is there already, rare kanji only."""
    from quire.operators.ruby import with_readings

    schema_books = plain_books(spark, sf, "ja")
    marked = schema_books.withColumn("chapters", F.transform("chapters", lambda c: c.withField("html", F.replace(F.replace(F.regexp_extract(c["html"], "<p>(.*)</p>", 1), F.lit("th"), F.lit("国")), F.lit("an"), F.lit("<ruby>国</ruby>")))))

    def load():
        import re

        return lambda text: [("国", "クニ") if x == "国" else (x, None) for x in re.findall("国|[^国]+", text)]

    done = with_readings(marked, load, frozenset("日"))
    back = F.transform("chapters", lambda c: F.replace(c["html"], F.lit("<ruby>国</ruby>"), F.lit("x国")))
    own = done.select(F.regexp_extract("src_path", r"(\d+)", 1).cast("long").alias("conv_id"), F.posexplode(back).alias("ord", "html"))
    return own


# Packages that others made


def package(r: dict) -> dict:
    """An EPUB 2 with a note, a picture in SVG, a lost one, links, a broken spine item, and an NCX whose parts lead nowhere."""
    files = {
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>', "O/i.png": "png",
        "META-INF/encryption.xml": '<encryption><CipherReference URI="O/f.otf"/></encryption>' if r["conv_id"] % 2 else "",
    }
    items, refs, points = [], [], []
    for x in r["turns"]:
        n = x["turn"]
        files[f"O/t {n}.html"] = (
            f'<html><head><title>no</title></head><body><h2>{x["role"]} <b>{n}</b></h2><p>{x["p"]}<a id="r" class="s" href="#f" epub:type="noteref">1</a> <a href="t%20{n + 1}.html#q">next</a> <a href="https://a/b">out</a></p>'
            f'<svg viewBox="0"><image xlink:href="I.png"/></svg><img src="lost.png"/><aside epub:type="Footnote" id="f"><p>note {n}</p></aside></body></html>'
        )
        items.append(f'<item id="t{n}" href="t%20{n}.html" media-type="application/xhtml+xml"/>')
        refs.append(f'<itemref idref="t{n}"/>')
        points.append(f'<navPoint><navLabel><text>{x["role"]} {n}</text></navLabel><content src="t%20{n}.html"/></navPoint>')
    files["O/t.ncx"] = f'<ncx><navMap><navPoint><navLabel><text>Part</text></navLabel><content src="gone.html"/>{"".join(points)}</navPoint></navMap></ncx>'
    files["O/c.opf"] = (
        f'<package unique-identifier="u"><metadata><dc:title>Book {r["conv_id"]}</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator><dc:language>ja</dc:language><dc:identifier id="u">id{r["conv_id"]}</dc:identifier><meta name="cover" content="im"/></metadata>'
        f'<manifest>{"".join(items)}<item id="im" href="i.png" media-type="image/png"/><item id="ncx" href="t.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="ncx" page-progression-direction="rtl">{"".join(refs)}<itemref idref="gone"/></spine></package>'
    )
    return {"path": f"{r['conv_id']}.epub", "content": samples.zip_file([(k, v.encode()) for k, v in files.items() if v])}


@query(f"""SELECT a.conv_id, a.ord, a.role || ' ' || a.turn AS title, 2 AS level,
'<h2>' || a.role || ' <b>' || a.turn || '</b></h2><p>' || a.p || '<a class="s noteref" id="r" href="#n' || (a.ord + 1) || '">1</a> ' || CASE WHEN b.ord IS NULL THEN 'next' ELSE '<a href="#ch' || (b.ord + 1) || '">next</a>' END
|| ' <a href="https://a/b">out</a></p><img src="O/i.png" />' AS html, '<p>note ' || a.turn || '</p>' AS note, 'A、B' AS author, 'id' || a.conv_id AS identifier, 'vertical-rl' AS mode, 'res-1' AS cover, a.role || ' ' || a.turn AS label,
'epub.broken-spine-item,' || CASE WHEN a.conv_id % 2 = 1 THEN 'epub.encrypted,' ELSE '' END || 'epub.missing-image' AS warnings
FROM {ROWS} a LEFT JOIN {ROWS} b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def epub_packages_read(spark, sf):
    """Packages: metadata, spine, notes, pictures in SVG, links between documents, NCX, covers, what is missing."""
    books = read_back(made(turns(spark, sf), package))
    codes = F.array_join(F.array_sort(F.transform("warnings", lambda w: w["code"])), ",")
    at = lambda column, field: F.get(column, F.col("ord"))[field]
    own = books.select("conv_id", F.posexplode("chapters").alias("ord", "c"), "notes", "nav", "cover", codes.alias("warnings"), "meta")
    return own.select(
        "conv_id", "ord", F.col("c.title").alias("title"), F.col("c.level").alias("level"), F.col("c.html").alias("html"), at("notes", "html").alias("note"), F.col("meta.author").alias("author"),
        F.col("meta.identifier").alias("identifier"), F.col("meta.writing_mode").alias("mode"), "cover", at("nav", "title").alias("label"), "warnings",
    )


def rich_books(spark, sf) -> DataFrame:
    """BOOK rows with a cover, a picture in each chapter, and a note in the first."""
    schema = C.arrow_schema(BOOK)

    def make(r: dict) -> list[dict]:
        from quire.model import chapter, nav_from_levels, new_book

        book = new_book(f"{r['conv_id']}.txt", title=f"Book {r['conv_id']}", language="zh-Hant", identifier=f"urn:x:{r['conv_id']}")
        for i, x in enumerate(r["turns"]):
            ref = '<a class="noteref" href="#n1">1</a>' if not i else ""
            chapter(book, f"{x['role']} {x['turn']}", f'<p>{x["p"]}{ref}<img src="images/p.png" alt="p" /></p>', 1)
        book["resources"] = [{"id": "a", "href": "images/p.png", "mime": "image/png", "data": PNG}, {"id": "b", "href": "images/c.png", "mime": "image/png", "data": PNG + b"cover"}, {"id": "x", "href": "images/unused.png", "mime": "image/png", "data": b"x"}]
        book["cover"], book["notes"] = "b", [{"id": "n1", "html": "<p>the note</p>"}, {"id": "n2", "html": "<p>an orphan</p>"}]
        nav_from_levels(book)
        return [book]

    return turns(spark, sf).mapInArrow(lambda it: C._rows(it, schema, make), BOOK)


@query(f"""SELECT conv_id, count(*) AS chapters, '<p>the note</p>|<p>an orphan</p>' AS notes, 'images/c.png' AS cover, count(*) AS pictures, 1::BIGINT AS refs FROM {ROWS} GROUP BY 1""")
def notes_and_pictures_kept(spark, sf):
    """Notes, pictures and the cover through EPUB and back."""
    books = read_back(C.written(rich_books(spark, sf), C.Options("epub")).select(F.col("name").alias("path"), "content"))
    count = lambda pattern: F.aggregate("chapters", F.lit(0).cast("long"), lambda n, c: n + F.size(F.regexp_extract_all(c["html"], F.lit(pattern), 0)))
    cover = F.get(F.filter("resources", lambda x: x["id"] == F.col("cover")), F.lit(0))["href"]
    return books.select(
        "conv_id", F.size("chapters").cast("long").alias("chapters"), F.array_join(F.transform("notes", lambda n: F.regexp_replace(n["html"], r"<a [^>]*>.*?</a>|\n", "")), "|").alias("notes"),
        cover.alias("cover"), count('<img src="images/p.png"').alias("pictures"), count('<a class="noteref"').alias("refs"),
    )


@query(f"""SELECT conv_id, 'Book ' || conv_id AS title, 'zh-Hant' AS language, 'img002' AS cover, 2 AS pictures, list_reduce([2166136261] || list_transform(string_split('urn:x:' || conv_id, ''), lambda c: ord(c)::BIGINT),
lambda h, c: (xor(h::BIGINT, c::BIGINT) * 16777619) % 4294967296)::BIGINT AS uid, 1028::BIGINT AS locale FROM (SELECT DISTINCT conv_id FROM {ROWS})""")
def mobi_headers(spark, sf):
    """What a MOBI's header and records say: identity, locale, language, cover and pictures in use."""
    files = C.written(rich_books(spark, sf), C.Options("mobi")).select(F.col("name").alias("path"), "content")
    read = read_back(files).select("conv_id", F.col("meta.title").alias("title"), F.col("meta.language").alias("language"), "cover", F.size("resources").alias("pictures"))
    u32 = lambda at: F.conv(F.hex(F.expr(f"substring(content, {at}, 4)")), 16, 10).cast("long")
    heads = files.withColumn("at", F.conv(F.hex(F.expr("substring(content, 79, 4)")), 16, 10).cast("int"))
    heads = heads.select(F.regexp_extract("path", r"(\d+)\.", 1).cast("long").alias("conv_id"), u32("at + 33").alias("uid"), u32("at + 93").alias("locale"))
    return read.join(heads, "conv_id")


@query(f"""SELECT conv_id, ord, role || ' ' || turn AS title FROM {ROWS}""")
def azw_of_either_kind(spark, sf):
    """Files named .azw: KF8 in them, or KF7."""
    eight = made(turns(spark, sf).where("conv_id % 2 = 0"), kf8)
    seven = C.written(plain_books(spark, sf).where("cast(regexp_extract(src_path, '([0-9]+)', 1) AS int) % 2 = 1"), C.Options("mobi")).select(F.col("name").alias("path"), "content")
    files = eight.unionByName(seven).withColumn("path", F.regexp_replace("path", r"\.\w+$", ".azw"))
    return chapters(read_back(files)).select("conv_id", "ord", "title")


@query("""SELECT conv_id, 'BookError: ' || (['the book is encrypted', 'the book is protected', 'Huffman compression isn''t supported'])[conv_id % 3 + 1] AS failure FROM (SELECT DISTINCT conv_id FROM conversations)""")
def protected_files(spark, sf):
    """Encrypted packages, protected and strangely compressed Kindle files are refused."""

    def make(r: dict) -> dict:
        if r["conv_id"] % 3 == 0:
            files = [("META-INF/container.xml", b'<rootfile full-path="c.opf"/>'), ("META-INF/encryption.xml", b'<CipherReference URI="t.html"/>')]
            return {"path": f"{r['conv_id']}.epub", "content": samples.zip_file(files)}
        data = bytearray(kf8(r)["content"])
        at = int.from_bytes(data[78:82], "big")
        if r["conv_id"] % 3 == 1:
            data[at + 12 : at + 14] = b"\0\2"
        else:
            data[at : at + 2] = (17480).to_bytes(2, "big")
        return {"path": f"{r['conv_id']}.azw3", "content": bytes(data)}

    return read_back(made(turns(spark, sf), make)).select("conv_id", "failure")


@query(f"""SELECT conv_id, '国' || ord AS title, '<p>国' || p || '<ruby>网<rt>網</rt></ruby></p>' AS html, '国书' AS author, ord FROM {ROWS}""")
def books_converted(spark, sf):
    """Variants in titles, people, chapters; readings stay."""
    from quire.operators.variants import DEMO, converted

    books = plain_books(spark, sf, "zh-Hant").withColumn("meta", F.col("meta").withField("author", F.lit("國書")))
    fresh = lambda c, i: c.withField("title", F.concat(F.lit("國"), i)).withField("html", F.concat(F.regexp_replace(F.regexp_replace(c["html"], "^<p>", "<p>國"), "</p>$", "<ruby>網<rt>網</rt></ruby></p>")))
    done = converted(books.withColumn("chapters", F.transform("chapters", fresh)), "t2cn", {"t2cn": DEMO})
    own = done.withColumn("conv_id", F.regexp_extract("src_path", r"(\d+)", 1).cast("long"))
    return chapters(own, F.col("meta.author").alias("author")).select("conv_id", "title", "html", "author", "ord")


@query(f"""WITH l AS (SELECT *, ord % 10 AS row, ord // 10 AS page FROM {ROWS}), g AS (SELECT *, CASE WHEN row IN (0, 3) THEN 1 ELSE 0 END AS start FROM l),
n AS (SELECT *, sum(start) OVER (PARTITION BY conv_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS para FROM g), k AS (SELECT conv_id FROM {ROWS} GROUP BY 1 HAVING count(*) > 0),
x AS (SELECT conv_id, para, min(ord) AS first, '<p>' || string_agg('turn ' || turn || ' of this book', ' ' ORDER BY ord) || '</p>' AS p FROM n GROUP BY 1, 2)
SELECT conv_id, string_agg(p, chr(10) ORDER BY first) AS html, 'page 1' AS label FROM x GROUP BY 1""")
def layouts_read(spark, sf):
    """Runs of text on pages, as a PDF engine gives them: lines from pieces out of order, paragraphs from gaps."""
    rows = turns(spark, sf).select("conv_id", F.posexplode("turns").alias("ord", "x")).withColumn("row", F.col("ord") % 10)
    y = F.lit(700.0) - 13.0 * F.col("row") - F.when(F.col("row") >= 3, 15.0).otherwise(0.0)
    piece = lambda text, x, dy: F.struct(F.col("ord").alias("k"), text.alias("str"), F.lit(x).alias("x"), (y + dy).alias("y"), F.lit(30.0).alias("width"), F.lit(10.0).alias("font"))
    both = F.explode(F.array(piece(F.lit("of this book"), 90.0, 0.5), piece(F.concat(F.lit("turn "), "x.turn"), 50.0, 0.0)))
    runs = rows.select(F.concat("conv_id", F.lit(".pdf")).alias("path"), (F.floor(F.col("ord") / 10) + 1).cast("int").alias("page"), both.alias("r")).select("path", "page", "r.str", "r.x", "r.y", "r.width", "r.font")
    labels = runs.select("path").distinct().select("path", F.lit(1).alias("page"), F.lit("page 1").alias("title"))
    books = C.read_layouts(runs, labels).withColumn("conv_id", F.regexp_extract("src_path", r"(\d+)", 1).cast("long"))
    return books.select("conv_id", F.get("chapters", F.lit(0))["html"].alias("html"), F.get("nav", F.lit(0))["title"].alias("label"))


# Details of writers and readers

MOBI_TEXT = f"""(SELECT conv_id, '<html><head><guide></guide></head><body>' || string_agg('<a id="c' || (ord + 1) || '"></a><h' || CASE WHEN turn % 3 = 0 THEN 1 ELSE 2 END || '>' || role || ' ' || turn || '</h' || CASE WHEN turn % 3 = 0 THEN 1 ELSE 2 END
|| '><p>' || p || '</p>', '<mbp:pagebreak/>' ORDER BY turn) || '</body></html>' AS x FROM {ROWS} GROUP BY 1)"""


@query(f"SELECT conv_id, strlen(x)::BIGINT AS bytes, ceil(strlen(x) / 4096)::BIGINT AS records, 4096::BIGINT AS size, 0::BIGINT AS seconds FROM {MOBI_TEXT}")
def mobi_records(spark, sf):
    """The text of a MOBI in records of 4 096 bytes, and what its header says of them."""
    files = C.written(plain_books(spark, sf), C.Options("mobi")).select("name", "content")
    number = lambda at, n: F.conv(F.hex(F.expr(f"substring(content, {at}, {n})")), 16, 10).cast("long")
    heads = files.withColumn("at", number(79, 4).cast("int"))
    return heads.select(
        F.regexp_extract("name", r"(\d+)\.", 1).cast("long").alias("conv_id"), number("at + 5", 4).alias("bytes"), number("at + 9", 2).alias("records"), number("at + 11", 2).alias("size"),
        (number(37, 4) - 2082844800).alias("seconds"),
    )


@query(f"""SELECT conv_id, count(*) * 1 AS pictures, 'data:image/png;base64,' || base64('\\x89PNG\\x0D\\x0A\\x1A\\x0Aimage'::BLOB) AS uri, 2::BIGINT AS notes FROM {ROWS} GROUP BY 1""")
def printable_pictures(spark, sf):
    """Pictures of printable files are in them; notes stand at their end."""
    out = C.written(rich_books(spark, sf), C.Options("html")).withColumn("text", F.decode("content", "UTF-8"))
    uris = F.regexp_extract_all("text", F.lit('<img src="([^"]*)"'), 1)
    return out.select(
        F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("conv_id"), F.size(uris).cast("long").alias("pictures"), F.array_join(F.array_distinct(uris), "|").alias("uri"),
        F.size(F.regexp_extract_all("text", F.lit("<aside id="), 0)).cast("long").alias("notes"),
    )


@query(f"""SELECT conv_id, left(t, 60) || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.xhtml' AS entry FROM (SELECT conv_id, t, row_number() OVER (PARTITION BY conv_id, lower(t) ORDER BY turn) AS k
FROM (SELECT conv_id, turn, role || '-' || repeat('x', 70) AS t FROM {ROWS}))""")
def epub_file_names(spark, sf):
    """Long and equal titles give short and distinct file names."""
    books = plain_books(spark, sf)
    long = F.transform("chapters", lambda c: c.withField("title", F.concat(F.regexp_extract(c["title"], r"^(\w+)", 1), F.lit(": "), F.repeat(F.lit("x"), 70))))
    found = zip_names(C.written(books.withColumn("chapters", long), C.Options("epub")), ".xhtml").where("entry <> 'nav.xhtml'")
    return found.select(F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("conv_id"), "entry")


def opened_docx(r: dict) -> dict:
    """A document whose opening is empty, holds a mark only, or is text."""
    import io
    import zipfile as z

    opening = ("", "<w:p><w:r><w:br/></w:r></w:p>", "<w:p><w:r><w:t>opening</w:t></w:r></w:p>")[r["conv_id"] % 3]
    whole = docx(r)["content"]
    out = io.BytesIO()
    with z.ZipFile(io.BytesIO(whole)) as a, z.ZipFile(out, "w") as b:
        for n in a.namelist():
            b.writestr(n, a.read(n).replace(b"<w:body>", b"<w:body>" + opening.encode()))
    return {"path": f"{r['conv_id']}.docx", "content": out.getvalue()}


@query(f"SELECT conv_id, count(*) + CASE WHEN conv_id % 3 = 2 THEN 1 ELSE 0 END AS chapters, CASE WHEN conv_id % 3 = 2 THEN NULL ELSE any_value(role || ' ' || turn) FILTER (ord = 0) END AS first FROM {ROWS} GROUP BY conv_id")
def word_openings(spark, sf):
    """What stands before the first heading is a chapter only if it has text."""
    books = read_back(made(turns(spark, sf), opened_docx))
    return books.select("conv_id", F.size("chapters").cast("long").alias("chapters"), F.get("chapters", F.lit(0))["title"].alias("first"))


@query("""SELECT conv_id, ext, CASE WHEN turns > 0 THEN 1 ELSE 0 END::BIGINT AS books FROM (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1), (VALUES ('txt'), ('md'), ('docx'), ('epub'), ('azw3'), ('zip')) v(ext)""")
def queue_of_files(spark, sf):
    """Files of all kinds in one job, each by its own reader."""
    rows = turns(spark, sf)
    makers = {"txt": text_file, "md": markdown_file, "docx": docx, "epub": package, "azw3": kf8}
    kinds = F.explode(F.array(*[F.lit(k) for k in [*makers, "zip"]]))

    def make(r: dict) -> dict:
        if r["ext"] != "zip":
            return makers[r["ext"]](r)
        return {"path": f"{r['conv_id']}.zip", "content": samples.zip_file([("one.txt", text_file(r)["content"])])}

    books = C.parsed_files(made(rows.withColumn("ext", kinds), make))
    ext = F.regexp_extract("src_path", r"^\d+\.(\w+)", 1)
    return books.where("failure IS NULL").groupBy(F.regexp_extract("src_path", r"^(\d+)", 1).cast("long").alias("conv_id"), ext.alias("ext")).agg(F.count("*").alias("books"))
