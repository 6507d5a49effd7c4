import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.model import BookError, validate
from quire.operators import nav, references, segment
from quire.operators import ruby as R
from quire.operators import validate as V
from quire.operators import variants
from quire.plans import conversion as C
from quire.sinks import epub as epub_sink
from quire.sinks import mobi as mobi_sink
from quire.sinks import texts
from quire.sources import archive, docx, epub, kindle, layout, markdown, plain
from quire.streaming import inbox

PNG = b"\x89PNG\r\n\x1a\nimage"


def zipped(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return b.getvalue()


def sample():
    b = markdown.read("# 第一\nhi *a*. B! [l](#two)\n## Two\n- a\n\n![i](./p.png)\n## Two\nx".encode(), "d/m.md", {"p.png": ("image/png", PNG)})
    b["notes"] = [{"id": "n1", "html": "<p>note</p>"}, {"id": "n2", "html": "<p>orphan</p>"}]
    b["chapters"][0]["html"] += '<p>x<a class="noteref" href="#n1">1</a></p>'
    b["cover"] = "img1"
    return b


@pytest.mark.parametrize("data,text,encoding,guessed", [
    ("a中".encode(), "a中", "utf-8", False), (b"\xef\xbb\xbfa", "a", "utf-8", False), ("a中".encode("utf-16"), "a中", "utf-16-le", False),
    (b"\xfe\xff" + "中".encode("utf-16-be"), "中", "utf-16-be", False), ("第一章 简体中文内容".encode("gb18030"), "第一章 简体中文内容", "gb18030", False), (b"\xff\xff\x81", None, "gb18030", True),
])
def test_encodings(data, text, encoding, guessed):
    got = plain.decoded(data)
    assert got[1:] == (encoding, guessed) and (text is None or got[0] == text)


def test_plain():
    b = plain.read("序\r\n第一章 a\r\n<x> \r\n\r\n第二回\ny\n第三章：no".encode(), "d/书.txt")
    assert [(c["title"], c["html"]) for c in b["chapters"]] == [(None, "<p>序</p>"), ("第一章 a", "<p>&lt;x&gt;</p>"), ("第二回", "<p>y</p>\n<p>第三章：no</p>")]
    assert b["meta"]["title"] == "书" and not b["nav"] and not validate(b)
    assert plain.read(b"a", "x.txt")["warnings"] == [{"code": "txt.no-chapters", "detail": None}]
    with pytest.raises(BookError):
        plain.read(b"", "x.txt")


def test_markdown():
    b = sample()
    assert [(c["title"], c["level"]) for c in b["chapters"]] == [("第一", 1), ("Two", 2), ("Two", 2)]
    assert '<a href="#ch2">l</a>' in b["chapters"][0]["html"] and [n["parent"] for n in b["nav"]] == [None, "n1", "n1"] and not validate(b)
    f = markdown.read(b"```\n# no\n```\n> q\n> > r\n\n* * *\n1. a\n2. b\n\n`<b>` ![x](http://h/y.png)", "f.md")
    (c,) = f["chapters"]
    assert "<pre><code># no</code></pre>" in c["html"] and "<blockquote><p>q</p>\n<blockquote><p>r</p></blockquote></blockquote>" in c["html"]
    assert "<hr />" in c["html"] and "<ol><li>a</li><li>b</li></ol>" in c["html"] and "<code>&lt;b&gt;</code>" in c["html"] and "<img" not in c["html"]
    assert {w["code"] for w in f["warnings"]} == {"md.no-chapters", "md.image-unresolved"}


def test_epub_round_trip():
    b = sample()
    data = epub_sink.write(b)
    assert data == epub_sink.write(b) and zipfile.ZipFile(io.BytesIO(data)).namelist()[0] == "mimetype"
    r = epub.read(data, "m.epub")
    assert not validate(r) and [c["title"] for c in r["chapters"]] == ["第一", "Two", "Two"] and [c["level"] for c in r["chapters"]] == [1, 2, 2]
    assert [(n["title"], n["parent"], n["target"]) for n in r["nav"]] == [("第一", None, "ch1"), ("Two", "n1", "ch2"), ("Two", "n1", "ch3")]
    assert [n["html"] for n in r["notes"]] == ["<p>note</p>", "<p>orphan</p>"] and r["cover"] and r["resources"][0]["data"] == PNG
    b["meta"]["writing_mode"] = "vertical-rl"
    assert epub.read(epub_sink.write(b), "m.epub")["meta"]["writing_mode"] == "vertical-rl"


def package(**more):
    files = {
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>',
        "O/c.opf": '<package unique-identifier="u"><metadata><dc:title>T</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator><dc:identifier id="u">id1</dc:identifier><meta name="cover" content="im"/></metadata>'
        '<manifest><item id="a" href="x%20y.html" media-type="application/xhtml+xml"/><item id="b" href="b.html"/><item id="im" href="i.png" media-type="image/png"/><item id="ncx" href="t.ncx" media-type="application/x-dtbncx+xml"/></manifest>'
        '<spine toc="ncx"><itemref idref="a"/><itemref idref="gone"/><itemref idref="b" linear="no"/></spine></package>',
        "O/x y.html": '<html><body><h2>One</h2><p>t<a href="#f" epub:type="noteref">1</a> <a href="b.html#q">b</a> <a href="no.html">n</a></p><svg><image xlink:href="I.PNG"/></svg><img src="lost.png"/><aside epub:type="footnote" id="f">foot</aside></body></html>',
        "O/b.html": "<body><p>two</p></body>", "O/i.png": PNG,
        "O/t.ncx": '<ncx><navMap><navPoint><navLabel><text>Part</text></navLabel><content src="gone.html"/><navPoint><navLabel><text>C1</text></navLabel><content src="x%20y.html"/></navPoint></navPoint><navPoint><navLabel><text>C2</text></navLabel><content src="b.html#z"/></navPoint></navMap></ncx>',
    } | more
    return zipped(files)


def test_epub_ncx_and_defects():
    b = epub.read(package(), "p.epub")
    assert (b["meta"]["title"], b["meta"]["author"], b["meta"]["identifier"]) == ("T", "A、B", "id1") and b["cover"] == b["resources"][0]["id"]
    one, two = b["chapters"]
    assert one["title"] == "One" and 'class="noteref" href="#n1"' in one["html"] and '<a href="#ch2">b</a>' in one["html"] and " n</p>" in one["html"] and "lost" not in one["html"]
    assert [(n["title"], n["parent"], n["target"], n["anchor"]) for n in b["nav"]] == [("C1", None, "ch1", None), ("C2", None, "ch2", "z")]
    assert {w["code"] for w in b["warnings"]} == {"epub.broken-spine-item", "epub.missing-image"} and b["notes"] == [{"id": "n1", "html": "foot"}] and not validate(b)
    font = {"META-INF/encryption.xml": '<encryption><CipherReference URI="f.otf"/></encryption>'}
    assert "epub.encrypted" in {w["code"] for w in epub.read(package(**font), "p.epub")["warnings"]}
    with pytest.raises(BookError):
        epub.read(package(**{"META-INF/encryption.xml": '<CipherReference URI="O/b.html"/>'}), "p.epub")


def test_kepub():
    with zipfile.ZipFile(io.BytesIO(epub_sink.write_kepub(sample()))) as z:
        text = z.read("第一.xhtml").decode()
    assert '<span class="koboSpan" id="kobo.1.1">第一</span>' in text and 'id="kobo.2.1">hi </span>' in text
    assert "".join(epub_sink.sentences("a. b! 好。」c")) == "a. b! 好。」c" and epub_sink.sentences("a. b! 好。」c") == ["a. ", "b! ", "好。」", "c"]


def test_docx():
    w = 'xmlns:w="w"'
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>b&amp;</w:t></w:r><w:r><w:footnoteReference w:id="2"/></w:r><w:r><w:drawing><a:blip r:embed="r1"/></w:drawing></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    data = zipped({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": '<R><Relationship Id="r1" Target="media/a.png"/></R>', "word/media/a.png": PNG,
                   "word/footnotes.xml": '<f><w:footnote w:id="2"><w:p><w:r><w:t>n</w:t></w:r></w:p></w:footnote></f>', "docProps/core.xml": "<c><dc:title>T</dc:title><dc:creator>A</dc:creator></c>"})
    b = docx.read(data, "d.docx")
    (c,) = b["chapters"]
    assert c["title"] == "H" and "<strong>b&amp;</strong>" in c["html"] and 'href="#footnote-2"' in c["html"] and "<table>" in c["html"] and b["resources"][0]["data"] == PNG
    assert (b["meta"]["title"], b["meta"]["author"]) == ("T", "A") and b["notes"][0]["html"] == "<p>n</p>" and not validate(b)
    with pytest.raises(BookError):
        docx.read(b"no", "d.docx")


def packed(text):
    """PalmDOC with back references where they pay."""
    out, i = bytearray(), 0
    while i < len(text):
        at = text.rfind(text[i : i + 3], max(0, i - 2047), i) if i + 3 <= len(text) else -1
        if at >= 0:
            out += struct.pack(">H", 0x8000 | (i - at) << 3)
            i += 3
        elif 9 <= text[i] < 0x80 or text[i] == 0:
            out.append(text[i])
            i += 1
        else:
            out += bytes((1, text[i]))
            i += 1
    return bytes(out)


def test_kindle():
    b = sample()
    r = kindle.read_azw(mobi_sink.write(b), "m.azw")
    assert [c["title"] for c in r["chapters"]] == ["第一", "Two", "Two"] and r["cover"] == "img001" and r["resources"][0]["data"] == PNG and r["meta"]["title"] == "第一"
    text = "the cat the cat <b>é</b> the cat".encode()
    assert kindle.unpacked(packed(text)) == text and kindle.unpacked(bytes([0xC1, 0x80, 0x28])) == b" A" + b"   "
    assert kindle.trimmed(b"abc\x81", 2) == b"abc" and kindle.trimmed(b"abcx\x01", 1) == b"abc" and mobi_sink.unique_id("") == 0x811C9DC5
    for broken in (b"", mobi_sink.write(b)[:100], b"x" * 200):
        with pytest.raises(BookError):
            kindle.read_azw(broken, "m.azw")


def index(rows, tags, strings=b""):
    head = b"INDX" + struct.pack(">IIIIIIIIIII", 56, 0, 0, 0, 0, 1, 65001, 0, 0, 0, 0) + struct.pack(">II", 0, 1 if strings else 0)
    tagx = b"TAGX" + struct.pack(">II", 12 + 4 * len(tags), 1) + b"".join(bytes(t) for t in tags)
    body, at = b"", []
    for name, data in rows:
        at.append(56 + len(body))
        body += bytes([len(name)]) + name + data
    rec = b"INDX" + struct.pack(">IIIIII", 56, 0, 0, 0, 56 + len(body), len(rows)) + b"\0" * 28 + body + b"IDXT" + b"".join(struct.pack(">H", x) for x in at)
    return [head.ljust(56, b"\0") + tagx, rec, *([strings] if strings else [])]


def v(n):
    return bytes([n >> 7 & 0x7F, n & 0x7F | 0x80]) if n > 127 else bytes([n | 0x80])


def test_kf8():
    s1, f1, s2 = b"<html><body><h1>A</h1></body></html>", b'<p aid="k">t <a href="kindle:pos:fid:0000:off:0000000000">l</a></p>', b"<html><body>two</body></html>"
    main = s1 + f1 + s2
    at = s1.index(b"</body>")
    skel = index([(b"S0", b"\x03" + v(1) + v(0) + v(len(s1))), (b"S1", b"\x02" + v(len(s1 + f1)) + v(len(s2)))], [(1, 1, 1, 0), (6, 2, 2, 0), (0, 0, 0, 1)])
    frag = index([(b"%010d" % at, b"\x01" + v(0) + v(len(f1)))], [(6, 2, 1, 0), (0, 0, 0, 1)])
    ncx = index([(b"0", b"\x03" + v(0) + v(0) + v(0))], [(3, 1, 1, 0), (6, 2, 2, 0), (0, 0, 0, 1)], v(5) + b"Entry" + b"\x80")
    recs = [b"", main, *skel, *frag, *ncx, PNG]
    h = bytearray(16 + 264)
    struct.pack_into(">HHIHHHH", h, 0, 1, 0, len(main), 1, 4096, 0, 0)
    h[16:20] = b"MOBI"
    struct.pack_into(">IIII", h, 20, 264, 2, 65001, 0)
    struct.pack_into(">I", h, 36, 8)
    for i, x in ((108, 9), (128, 0), (168, 0xFFFFFFFF), (192, 0xFFFFFFFF), (244, 6), (248, 4), (252, 2)):
        struct.pack_into(">I", h, i, x)
    recs[0] = bytes(h)
    out, pos = b"t".ljust(60, b"\0") + b"BOOKMOBI" + b"\0" * 8 + struct.pack(">H", len(recs)), 78 + 8 * len(recs)
    for r in recs:
        out += struct.pack(">II", pos, 0)
        pos += len(r)
    b = kindle.read_azw3(out + b"".join(recs), "k.azw3")
    assert [c["html"] for c in b["chapters"]] == ['<h1>A</h1><p id="aid-k">t <a href="#c1">l</a></p>', "two"]
    assert [(n["title"], n["target"]) for n in b["nav"]] == [("Entry", "c1")] and not validate(b)


def test_archive():
    inner = zipped({"deep.txt": "第一章\nx", "more.zip": zipped({"a.txt": "b"})})
    data = zipped({"b/m.md": "# T\n![i](p.png)", "b/p.png": PNG, "a.txt": "text", "bad.epub": "no", "x.pdf": "p", "x.exe": "e", "__MACOSX/._a.txt": "j", ".DS_Store": "j", "in.zip": inner})
    books = archive.read_all(data, "z.zip", C.READERS)
    assert [b["src_path"] for b in books] == ["z.zip/a.txt", "z.zip/b/m.md", "z.zip/bad.epub", "z.zip/in.zip/deep.txt"]
    assert [bool(b["failure"]) for b in books] == [False, False, True, False] and books[1]["resources"][0]["data"] == PNG
    assert {w["code"]: w["detail"] for w in books[0]["warnings"] if w["code"][:3] == "zip"} == {"zip.skipped": "x.exe", "zip.unsupported": "x.pdf", "zip.nested-too-deep": "in.zip/more.zip"}
    assert archive.read_all(data, "z.zip", C.READERS, first=True)[0]["warnings"][-1]["code"] == "zip.multiple-books"
    gbk = zipfile.ZipInfo("x")
    gbk.filename, gbk.flag_bits = "书.txt".encode("gb18030").decode("cp437"), 0
    assert archive.entry_name(gbk) == "书.txt"


def run(s, x, y, font=10.0):
    return {"str": s, "x": x, "y": y, "width": 10.0, "font": font}


def test_layout():
    page = [run("world", 50, 700), run("hello", 10, 700.5), run("more text of it", 10, 687), run("indented", 30, 674), run("far below", 10, 600)]
    b = layout.read([page], "p.pdf", {1: "One"})
    assert [c["html"] for c in b["chapters"]] == ["<p>hello world more text of it</p>\n<p>indented</p>", "<p>far below</p>"] and b["nav"][0]["target"] == "pdf-ch-1"
    pages = [[run(f"page {i} with words", 10, 700)] for i in range(45)]
    assert len(layout.read(pages, "p.pdf")["chapters"]) == 3
    for bad in ([[run("x", 1, 1)]],):
        with pytest.raises(BookError):
            layout.read(bad, "p.pdf")


def test_page_paragraphs(spark):
    rows = [("b", 1, 0, "a", 10.0, 700.0, 10.0), ("b", 1, 1, "b", 10.0, 687.0, 10.0), ("b", 1, 2, "c", 30.0, 674.0, 10.0), ("b", 1, 3, "d", 10.0, 600.0, 10.0), ("n", 1, 0, "x", 10.0, 9.0, 10.0), ("n", 21, 0, "y", 10.0, 9.0, 10.0)]
    d = spark.createDataFrame(rows, "book_id string, page int, pos int, text string, x0 double, y double, font double")
    got = {(r.book_id, r.text): (r.para, r.chapter) for r in segment.page_paragraphs(d).collect()}
    assert got == {("b", "a"): (1, 0), ("b", "b"): (1, 0), ("b", "c"): (2, 0), ("b", "d"): (3, 1), ("n", "x"): (1, 0), ("n", "y"): (2, 1)}


def test_variants_and_readings(spark):
    c = variants.Converter(variants.DEMO)
    assert c.html("<b>網際網路</b><rt>網</rt>書") == "<b>互联网</b><rt>網</rt>书" and variants.Converter({}).text("x") == "x"
    assert R.annotated("生まれ", "ウマレ") == R.mark("生", "う") + "まれ" and R.annotated("見当", "ミ") == R.mark("見当", "み") and R.annotated("かな", "カナ") == "かな"
    assert R.annotated("日本語", "ニホンゴ", frozenset("日本語")) == "日本語" and R.aligned("取り引き", "トリヒキ") == [("取", "と"), ("り", None), ("引", "ひ"), ("き", None)]
    tokens = lambda text: [(text, "ニホン" if text == "日本" else None)]
    assert R.annotate_html("<p>日本</p><ruby>日本<rt>x</rt></ruby>", tokens) == f"<p>{R.mark('日本', 'にほん')}</p><ruby>日本<rt>x</rt></ruby>"
    d = spark.createDataFrame([("to_simplified", "tw", "ja-JP"), ("to_traditional", "hk", None), ("none", "none", "zh")], "d string, r string, l string")
    rows = d.select(variants.scheme_for(F.col("d"), F.col("r")).alias("s"), variants.effective_scheme(F.col("l"), F.lit("t2cn")).alias("e")).collect()
    assert [tuple(r) for r in rows] == [("twp2cn", "none"), ("cn2hk", "t2cn"), ("none", "t2cn")]


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.txt").write_text("第一章 網路\n軟體")
    (d / "b.epub").write_bytes(epub_sink.write(sample()))
    (d / "c.zip").write_bytes(zipped({"x.md": "# M\ny", "bad.docx": "no"}))
    (d / "d.mobi").write_bytes(b"broken")
    return d


def test_conversion(spark, folder):
    books = C.read_books(spark, str(folder)).cache()
    got = {r.src_path.rpartition("/in/")[2]: r for r in books.collect()}
    assert set(got) == {"a.txt", "b.epub", "c.zip/x.md", "c.zip/bad.docx", "d.mobi"} and {k for k, r in got.items() if r.failure} == {"c.zip/bad.docx", "d.mobi"}
    t = C.tables(books)
    assert t["books"].count() == 3 and t["failures"].count() == 2 and t["chapters"].count() == 5 and t["resources"].first().mime == "image/png"
    found = V.errors(t["books"], t["chapters"], t["nav"], t["notes"], t["resources"])
    assert found.count() == 0 and all(r.ok for r in V.verdicts(t["books"], found).collect())
    out = {r.name: r for r in C.convert(books, C.Options("txt", "t2cn", tag="简"), {"t2cn": variants.DEMO}).collect()}
    assert out["a（简）.txt"].content.decode("utf-8-sig") == "第一章 网路\n\n软件" and out["d（简）.txt"].failure
    for fmt in C.WRITERS:
        assert sum(r.content is not None for r in C.convert(books, C.Options(fmt, writing_mode="vertical-rl")).collect()) == 3
    with pytest.raises(ValueError):
        C.Options("doc")
    with pytest.raises(ValueError):
        C.convert(books, C.Options("txt", "t2cn"))


def test_stream(spark, folder, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):  # a restart converts nothing again
        inbox.conversions(spark, str(folder), out, check, C.Options("epub")).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 5 and sum(r.failure is None for r in rows) == 3


def test_validation(spark):
    books = spark.createDataFrame([("b", "T", "", "i", "sideways", "c9"), ("e", "T", "l", "i", "horizontal-tb", None)], "book_id string, title string, language string, identifier string, writing_mode string, cover_rid string")
    chapters = spark.createDataFrame([("b", 1, "c1", 4, '<p><font>x</font><img src="no.png" /><img src="http://h/i" /><a class="noteref" href="#n9">1</a></p>'), ("b", 2, "c1", 1, "")], "book_id string, ord int, chapter_id string, level int, html string")
    nav_rows = spark.createDataFrame([("b", "zz")], "book_id string, target string")
    notes, res = spark.createDataFrame([], "book_id string, note_id string"), spark.createDataFrame([("b", "r", None, "m", b"")], "book_id string, rid string, href string, mime string, data binary")
    found = V.errors(books, chapters, nav_rows, notes, res)
    assert sorted((r.book_id, r.check) for r in found.collect()) == sorted([("b", c) for c in V.CHECKS if c not in ("title", "identifier", "no chapter")] + [("e", "no chapter")])


def test_nav_and_references(spark):
    rows = [("b", i, lv) for i, lv in enumerate([1, 2, 3, 2, 3, 3, 1, 3, 2])]
    t = nav.tree_from_levels(spark.createDataFrame(rows, "k string, ord int, level int"), "k")
    assert [(r.parent, r.depth) for r in t.orderBy("ord").collect()] == [(None, 1), (0, 2), (1, 3), (0, 2), (3, 3), (3, 3), (None, 1), (6, 2), (6, 2)]
    n = spark.createDataFrame([("b", "a", None, 1, "A", "gone"), ("b", "b", "a", 1, "B", "c1"), ("b", "c", "b", 1, "C", "c2"), ("b", "d", None, 2, "D", "c3")], "book_id string, node_id string, parent_id string, sib_ord int, title string, target string")
    p = nav.preorder(n)
    assert [(r.node_id, r.depth, r.pre_ord) for r in p.orderBy("pre_ord").collect()] == [("a", 1, 1), ("b", 2, 2), ("c", 3, 3), ("d", 1, 4)]
    kept = nav.promoted(p, spark.createDataFrame([("b", x) for x in ("c1", "c2", "c3")], "book_id string, target string"))
    assert {(r.node_id, r.parent_id) for r in kept.collect()} == {("b", None), ("c", "b"), ("d", None)}
    parts = spark.createDataFrame([("b", "p1", 0, 150), ("b", "p2", 150, 400), ("b", "p3", 100, 120)], "book_id string, part_id string, start long, stop long")
    pos = spark.createDataFrame([("b", x) for x in (0, 110, 149, 150, 399, 400)], "book_id string, pos long")
    got = {r.pos: (r.part_id, r.offset) for r in references.ranged(pos, parts, 100).collect()}
    assert got == {0: ("p1", 0), 110: ("p1", 110), 149: ("p1", 149), 150: ("p2", 0), 399: ("p2", 249)} or got.get(400) == (None, None)
    ch = spark.createDataFrame([("b", 1, "c1", '<a href="#n1">x</a><img src="i" /><img src="lost" />'), ("b", 2, "c2", '<a href="#n1">x</a>')], "book_id string, ord int, chapter_id string, html string")
    notes = spark.createDataFrame([("b", "n1"), ("b", "n2")], "book_id string, note_id string")
    assert {(r.note_id, r.chapter_id) for r in references.note_places(ch, notes).collect()} == {("n1", "c1"), ("n2", "c2")}
    res = spark.createDataFrame([("b", "i"), ("b", "k"), ("b", "u")], "book_id string, href string")
    cover = spark.createDataFrame([("b", "k")], "book_id string, href string")
    assert [(r.href, r.number) for r in references.used_resources(ch, res, cover).orderBy("number").collect()] == [("k", 1), ("i", 2)]
    assert [r.src for r in references.missing_images(ch, res).collect()] == ["lost"]
    items = spark.createDataFrame([("b", 1, "x"), ("b", 2, "y")], "book_id string, ord int, idref string")
    found, lost = references.spine(items, spark.createDataFrame([("b", "x", "h")], "book_id string, id string, href string"))
    assert [r.href for r in found.collect()] == ["h"] and [r.detail for r in lost.collect()] == ["y"]
    entries = spark.createDataFrame([("b", "A.html", 1), ("b", "a.html", 2), ("b", "I.PNG", 3)], "book_id string, path string, ord int")
    w = spark.createDataFrame([("b", "a.html"), ("b", "i.png"), ("b", "no")], "book_id string, path string")
    assert {(r.path, r.entry) for r in references.by_path(w, entries).collect()} == {("a.html", "a.html"), ("i.png", "I.PNG"), ("no", None)}


def test_texts():
    b = sample()
    assert texts.write_txt(b).decode("utf-8-sig").startswith("第一\n\nhi a. B! l\nx1")
    page = texts.write_html(b).decode()
    assert "data:image/png;base64," in page and '<nav><ol><li><a href="#ch1">第一</a><ol>' in page and '<aside id="n1">' in page


def test_kindle_languages():
    for tag, code, want in [("ja", 0x0411, "ja"), ("zh-Hant", 0x0404, "zh-Hant"), ("en", 0x0409, "en"), ("ko", 0x0412, "ko")]:
        book = sample()
        book["meta"]["language"] = tag
        data = mobi_sink.write(book)
        assert kindle.Header(kindle.records(data)).u32(92) == code and kindle.read_mobi(data, "x.mobi")["meta"]["language"] == want
        without = data.replace(struct.pack(">II", 524, 8 + len(tag)), struct.pack(">II", 999, 8 + len(tag)))
        assert kindle.read_mobi(without, "x.mobi")["meta"]["language"] == ("zh-Hans" if tag == "zh-Hant" else want)
    assert [kindle.language_of_tag(x) for x in ("zh-TW", "zh-CN", "JA-jp", "pt-BR", None, "")] == ["zh-Hant", "zh-Hans", "ja", "pt-BR", None, None]
    assert [kindle.language_of_locale(c, True) for c in (0x0404, 0x0C04, 0x0804, 0x0414, 0, 0x0419)] == ["zh-Hant", "zh-Hant", "zh-Hans", "no", None, "ru"]


def test_undefined_bytes_of_windows_1252():
    assert b"a\x81\x93\x9d".decode("cp1252", "c1") == "a\x81“\x9d"


def test_notes_of_outputs_and_readings(spark, tmp_path):
    (tmp_path / "a.txt").write_text("第一章\n日本", encoding="utf-8")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4")
    books = C.read_books(spark, str(tmp_path))
    assert [r.failure.split(": ")[1] for r in books.where("failure is not null").collect()] == ["files of type pdf can't be read"]
    good = books.where("failure is null")
    ja = good.withColumn("meta", F.col("meta").withField("language", F.lit("ja")).withField("writing_mode", F.lit("vertical-rl")))
    load = lambda: lambda text: [("日本", "ニホン") if x == "日本" else (x, None) for x in text.split()]
    (out,) = C.convert(ja, C.Options("epub", scheme="t2cn", tag=None, readings="all"), {"t2cn": variants.DEMO}, load).collect()
    text = "".join(c["html"] for c in epub.read(bytes(out.content), "a.epub")["chapters"])
    assert "<rt>にほん</rt>" in text and out.name == "a.epub" and out.notes == ["Characters weren't converted: the book is Japanese."]
    (out,) = C.convert(ja, C.Options("mobi", readings="all")).collect()
    assert out.notes == ["Reading marks weren't made: this format can't hold them.", "The vertical writing mode isn't kept by this format."]
    (out,) = C.convert(good, C.Options("txt", scheme="t2cn", tag=None), {"t2cn": variants.DEMO}).collect()
    assert out.name == "a（简体）.txt" and out.notes == []
    with pytest.raises(ValueError, match="tokenizer"):
        C.convert(ja, C.Options("epub", readings="rare"))


def test_dictionaries_in_text_form():
    words = variants.read_dictionary(["# x", "網際網路\t互联网 因特网\n", "網\t网", "", "壞"])
    assert words == {"網際網路": "互联网", "網": "网"}
    c = variants.Converter([words, {"互联网": "網路"}])
    assert c.text("網際網路網x") == "網路网x" and variants.Converter({}).text("a") == "a"


def test_first_book_of_an_archive(spark, tmp_path):
    (tmp_path / "z.zip").write_bytes(zipped({"b.txt": "第二章\nb", "a.txt": "第一章\na"}))
    (book,) = C.read_books(spark, str(tmp_path), first=True).collect()
    assert book.src_path.endswith("a.txt") and [w.code for w in book.warnings] == ["zip.multiple-books"]


def test_note_references_keep_their_attributes():
    page = '<html><body><h1>A</h1><p>x<a id="r1" class="sup" epub:type="noteref" href="#f1">1</a></p><aside epub:type="FootNote" id="f1"><p>n</p></aside></body></html>'
    book = epub.read(package(**{"O/x y.html": page}), "x.epub")
    assert '<a class="sup noteref" id="r1" href="#n1">' in book["chapters"][0]["html"] and book["notes"][0]["html"] == "<p>n</p>"
    assert [(n["title"], n["level"]) for n in book["nav"]] == [("C1", 2), ("C2", 1)] and book["chapters"][0]["level"] == 2
